"""The training-text operators against brute force, on small tables with nulls, empty texts, ties and clashing names."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrack.llm import bpe, chat_format, decontaminate, exact_dedup, histogram_shards, language_id, lexicon, packing, periodic_runs, phrases, queries, repeated_passages, shingle_join, token_counts, toxicity
from kinetrack.llm.tables import written

SF = "/root/testdata/sf0.001"
#: Columns whose names the operators use for themselves.
CLASHING = ("rid", "name", "score", "predicted", "kept", "keep_id", "group_size", "spans", "n_words", "size", "lang_pred", "id", "key", "bytes")
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, changes, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


PASSAGE = prose(70, "passage")
TEXTS = [
    None, "", "  \n ", "word", "Word", "two words", "a b c d e", "A B C D E",
    prose(300, 1), prose(300, 1), prose(300, 1).upper(), edited(prose(300, 1), 3, 2), edited(prose(300, 1), 4, 3), edited(prose(300, 1), 20, 4),
    prose(120, 5) + " " + PASSAGE + " " + prose(80, 6), prose(40, 7) + "\n" + PASSAGE + "\n" + prose(100, 8), PASSAGE,
    "the " * 500, "the " * 400 + "end", "ö" * 300, "x" * 70_000, prose(9000, 9), prose(9000, 9) + " more", "naïve  café x   <|endoftext|> 12ab'll",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] + [(3, "word", "en"), (None, prose(60, 12), None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3, "lang", "text")
    return df.withColumns({c: F.lit(c) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def brute_sets(rows):
    out = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def components(ids, sets):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[top(i)] = top(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(top(i), []).append(i)
    names = {}
    for own in groups.values():
        known = [ids[i] for i in own if ids[i] is not None]
        names |= {i: min(known) if known else None for i in own}
    return names


def test_jaccard_components(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = brute_sets([t for _, t in rows])
    names = components([i for i, _ in rows], sets)
    want = sorted(((i, len(s), names[k]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in shingle_join.jaccard_components(docs).collect()), key=repr)
    assert got == want
    assert shingle_join.jaccard_components(empty).count() == 0
    assert shingle_join.keep_one_of_each(docs).columns == docs.columns


def test_jaccard_join_splits_large_neighbourhoods(spark, monkeypatch):
    """Many near copies: blocks are searched in pairs, and the result is that of brute force."""
    base = prose(60, 20)
    rows = [(i, edited(base, i % 5, i)) for i in range(120)] + [(200 + i, prose(60, 300 + i)) for i in range(20)]
    sets = brute_sets([t for _, t in rows])
    names = components([i for i, _ in rows], sets)
    monkeypatch.setattr(shingle_join, "BLOCK_BYTES", 4096)
    got = {r.doc_id: r.component_id for r in shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: names[k] for k, (i, _) in enumerate(rows)}


def test_components_along_a_path(spark):
    from kinetrack.llm.tables import min_label

    order = list(range(50))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in min_label(edges).collect()}
    assert got == {**dict.fromkeys(range(50), 0), 100: 100, 101: 100}


def test_compact_windows_are_cartesian_nodes():
    r = np.random.default_rng(2)
    for n in (5, 40, 200):
        v = r.integers(0, 30, n).astype(np.uint64)
        want = set()
        for c in range(n):
            if v[c]:
                a = b = c
                while a > 0 and v[a - 1] > v[c]:
                    a -= 1
                while b + 1 < n and v[b + 1] >= v[c]:
                    b += 1
                if b - a + 1 >= 6:
                    want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in repeated_passages.compact_windows(v, 6)))) == want


def test_repeated_passages(docs, empty):
    got = repeated_passages.repeated_passages(docs).collect()
    pairs = {(r.doc_id, r.partner_id) for r in got}
    found = {i for p in pairs for i in p}
    assert {8, 9, 10, 11, 12, 14, 15, 16, 21, 22} <= found
    assert not found & {0, 1, 2, 3, 4, 5, 6, 7, 19, 20, 23}
    inside = [r for r in got if r.doc_id == 14]
    assert any(abs(r.start_word - 120) <= 5 and abs(r.n_words - 70) <= 10 for r in inside)
    assert repeated_passages.repeated_passages(empty).count() == 0


def test_middle_holders_of_a_common_line_are_paired(spark):
    # Documents that share a passage whose centres all lie in a common line: first, last and others only share the line.
    least = 46
    line, rows, want = prose(45, "line"), [], set()
    for i in range(40):
        rows.append((i, prose(60, f"a{i}") + " " + line + " " + prose(60, f"b{i}")))
    for i in range(10, 30, 2):
        for j, k in ((0, 3), (1, 2), (2, 1), (3, 3)):
            head, tail = prose(k, f"h{i}{j}"), prose(6 - k, f"t{i}{j}")
            rows += [(1000 * (j + 1) + i + m, f"{prose(60, f'c{i}{j}{m}')} {head} {line} {tail} {prose(60, f'd{i}{j}{m}')}") for m in (0, 1)]
            want.add((1000 * (j + 1) + i, 1000 * (j + 1) + i + 1))
    rows += [(9000 + i, prose(60, f"e{i}") + " " + line + " " + prose(60, f"f{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = repeated_passages.repeated_passages(df).collect()
    assert want <= {(r.doc_id, r.partner_id) for r in got} | {(r.partner_id, r.doc_id) for r in got}
    assert all(r.n_words >= least + 4 and r.partner_words >= least + 4 for r in got)


def test_near_copies_of_common_lines_are_linked(spark):
    # Two documents share two common lines around a changed word; all first holders have only one of the lines.
    assert repeated_passages.certain_run(46) == 21
    rows, want = [], set()
    for i in range(6):
        one, two = prose(30, f"one{i}"), prose(30, f"two{i}")
        rows += [(100 * i + j, f"{prose(60, f'a{i}{j}')} {one if j % 2 else two} {prose(60, f'b{i}{j}')}") for j in range(20)]
        rows += [(100 * i + j, f"{prose(60, f'a{i}{j}')} {one} changed{j} {two} {prose(60, f'b{i}{j}')}") for j in (50, 51)]
        want.add((100 * i + 50, 100 * i + 51))
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got} == want


def test_holders_of_a_common_run_are_not_all_compared(spark, monkeypatch):
    # 80 documents share a line of 24 tokens; only those with the same words after a changed one share a passage.
    line, rows, want, seen = prose(28, "run"), [], set(), []
    rows += [(i, f"{prose(60, f'u{i}')} {line} {prose(60, f'v{i}')}") for i in range(70)]
    for i in range(5):
        tail = prose(25, f"tail{i}")
        rows += [(100 + 2 * i + j, f"{prose(60, f'x{i}{j}')} {line} changed{i}{j} {tail} {prose(60, f'y{i}{j}')}") for j in (0, 1)]
        want.add((100 + 2 * i, 101 + 2 * i))
    verified = repeated_passages._verified
    monkeypatch.setattr(repeated_passages, "_verified", lambda texts, loose, least: seen.append(loose.distinct().count()) or verified(texts, loose, least))
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)) for r in got} == want
    assert sum(seen) <= len(rows)


def test_texts_without_common_runs_are_not_shuffled(spark):
    # Two documents of many are near copies: without broadcasts only their tokens are joined, not the texts of all.
    rows = [(i, prose(2000, f"lone{i}")) for i in range(120)]
    left, right = prose(40, "left"), prose(40, "right")
    rows += [(500 + j, f"{prose(60, f'a{j}')} {left} changed{j} {right} {prose(60, f'b{j}')}") for j in (0, 1)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList()).iterator()
        while found.hasNext():
            s = found.next()
            yield s.stageId(), s.shuffleWriteBytes()

    last = max(i for i, _ in stages())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = repeated_passages.repeated_passages(df).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.doc_id, r.partner_id, r.n_words >= 81) for r in got} == {(500, 501, True), (501, 500, True)}
    time.sleep(1)  # figures of stages come a little later
    assert sum(n for i, n in stages() if i > last) < 0.5 * sum(len(t) for _, t in rows)


def test_spans_of_passages_found_later_are_merged(spark):
    names = "x long, y long, x_start long, x_words long, y_start long, y_words long"
    r = random.Random(5)
    rows = [(a, b, r.randrange(300), r.randint(50, 90), r.randrange(300), r.randint(50, 90)) for a, b in ((r.randrange(30), r.randrange(30)) for _ in range(60)) if a != b]
    df = lambda part: spark.createDataFrame(part, names)
    whole = repeated_passages._spans(df(rows)).collect()
    assert sorted(repeated_passages._spans(df(rows[25:]), repeated_passages._spans(df(rows[:25]))).collect()) == sorted(whole) and len(whole) > 30


def test_spans_that_count_are_never_ruled_out():
    # Against all spans: random rows of tokens with edits on both sides.
    r, least = np.random.default_rng(9), 20
    counted = ruled_out = 0
    for _ in range(400):
        words = [f"w{v}" for v in r.integers(0, 10**6 if r.random() < 0.7 else 40, 64)]
        other = list(words)
        for at in r.integers(0, 64, r.integers(1, 6)):
            other[at : at + r.integers(0, 2)] = [f"e{v}" for v in r.integers(0, 10**6, r.integers(0, 3))]
        x, y = ([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] for w in (words, other))
        again = np.array([t in x[:i] for i, t in enumerate(x)])
        plain = len(set(x)) == len(x) and len(set(y)) == len(y) and len({" ".join(words[i : i + 4]) for i in range(61)}) == 61
        at = int(r.integers(0, len(x)))
        may = bool(repeated_passages._may_count(np.isin(x, y)[None], again[None], np.array([at]), np.array([plain]), least)[0])
        brute = any(5 * len(set(x[a:b]) & set(y[c:d])) >= 4 * len(set(x[a:b]) | set(y[c:d])) for a in range(at + 1) for b in range(max(at + 1, a + least), min(len(x), a + least + 6) + 1) for c in range(max(0, a - 3), a + 4) for d in range(c + least, min(len(y), c + least + 6) + 1))
        assert may or not brute
        counted, ruled_out = counted + brute, ruled_out + (not may)
    assert counted > 20 and ruled_out > 20


def test_every_place_of_a_repeated_passage_is_listed(spark):
    parts = [w for i in range(6) for w in (prose(70, f"p{i}"), PASSAGE)]
    rows = [(1, " ".join(parts)), (2, prose(90, "q") + " " + PASSAGE), (3, PASSAGE + " " + prose(90, "r"))]
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).where("doc_id = 1").collect()
    assert {70 + 140 * i for i in range(6)} <= {r.start_word for r in got}


def test_a_passage_is_tied_to_the_partner_that_shares_it(spark):
    # 0 and 3 share a passage around a line; 0 shares more centres with 1, and 3 with 2, but there only the line.
    rows, want = [], set()
    for i in range(10):
        line, long, other = prose(44, f"line{i}"), prose(400, f"long{i}"), prose(400, f"other{i}")
        left, right = prose(3, f"left{i}"), prose(3, f"right{i}")
        ends = [(left, right), (prose(3, f"l1{i}"), prose(3, f"r1{i}")), (prose(3, f"l2{i}"), prose(3, f"r2{i}")), (left, right)]
        for j, (head, tail) in enumerate(ends):
            middle = f"{head} {line} {tail}"
            rows.append((10 * i + j, f"{long} {middle}" if j < 2 else f"{middle} {other}"))
        want.add((10 * i + 3, 10 * i))
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert want <= {(r.doc_id, r.partner_id) for r in got}


def test_one_edit_anywhere_in_a_passage():
    # Against all spans: a passage of 50 to 70 words with one word changed.
    r, least = np.random.default_rng(5), 46
    tokens = lambda words: np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(len(words) - 4)], np.uint32)
    word = lambda n: [f"w{v}" for v in r.integers(0, 10**6, n)]
    checked = 0
    for n in (50, 51, 55, 60, 70):
        for at in range(n):
            for kind in ("change", "repeat"):
                passage = word(n)
                if kind == "repeat":
                    passage[n // 2] = passage[0]
                other = passage[:at] + word(1) + passage[at + 1 :]
                x, y = tokens(word(20) + passage + word(20)), tokens(word(20) + other + word(20))
                same = [i for i in np.flatnonzero(x == y)]
                for s in {same[0], same[len(same) // 2], same[-1]}:
                    brute = False
                    for a in range(s + 1):
                        for b in range(max(s, a + least - 1), len(x)):
                            u, v = set(x[a : b + 1].tolist()), set(y[a : b + 1].tolist())
                            brute = brute or 5 * len(u & v) >= 4 * len(u | v)
                        if brute:
                            break
                    found = repeated_passages.similar_passages(x, y, [int(s)], least)
                    assert bool(found) == brute, (n, at, s)
                    checked += brute
                    for a, b, c, d, _ in found:
                        u, v = set(x[a : b + 1].tolist()), set(y[c : d + 1].tolist())
                        assert a <= s <= b and min(b - a, d - c) + 1 >= least and 5 * len(u & v) >= 4 * len(u | v)
    assert checked > 500


def test_repeats_are_cut_from_all_but_one(spark):
    rows = [(1, prose(100, 31) + " " + PASSAGE), (2, PASSAGE + " " + prose(100, 32)), (3, None)]
    out = {r.doc_id: r.text for r in repeated_passages.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert out[3] is None
    assert sum(PASSAGE in t for t in (out[1], out[2])) == 1 and sum(len(out[i].split()) for i in (1, 2)) < 290


def test_shards_by_bytes(docs, empty, spark):
    many = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, prose(i % 30, i % 97)) for i in range(3000)], "doc_id long, text string"))
    got = histogram_shards.shard_by_bytes(many.where("coalesce(octet_length(text), 0) < 5000"), 16).collect()
    assert len(got) == many.where("coalesce(octet_length(text), 0) < 5000").count()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in got)
    assert set(sizes) == set(range(16))
    assert all(abs(sum(r.size for r in s) - total / 16) < 0.02 * total / 16 + 5000 for s in sizes.values())
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in sizes.values())
    texts = {(r.doc_id): r.text or "" for r in many.where("doc_id is not null").collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got if r.doc_id is not None)
    assert histogram_shards.shard_by_bytes(empty).count() == 0


def test_shards_split_one_large_group(spark):
    rows = [(i, "same text") for i in range(4000)] + [(10_000 + i, prose(5, i)) for i in range(2000)]
    got = histogram_shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    sizes = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 4 and max(sizes) < 1.05 * min(sizes)


def test_shards_split_repeated_rows(spark):
    # Rows that agree in everything, and null ids, are still cut within the tolerance and one row.
    rows = [(7, "same text")] * 4000 + [(None, "same text")] * 1000 + [(10_000 + i, prose(5, i)) for i in range(1000)]
    got = histogram_shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4)
    sizes = got.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r.s for r in sizes) / 4
    assert len(sizes) == 4 and all(abs(r.s - mean) <= 0.01 * mean + 40 and r.n == r.slots == r.last + 1 for r in sizes)


def test_foreign_columns_keep_their_values(spark, docs):
    """Columns that are named like an operator's own ones pass through with their values."""
    bench = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    more = docs.withColumns({"n_words": F.lit(7), "spans": F.lit("s"), "__cut": F.lit(2), "v": F.lit(3)})
    values = lambda df: {(r.n_words, r.spans, r.v, r["__cut"], r.rid, r.bytes, r.kept) for r in df.collect()}
    want = {(7, "s", 3, 2, "rid", "bytes", "kept")}
    assert values(decontaminate.drop_contaminated(more, bench)) == want
    assert values(exact_dedup.drop_exact_copies(more)) == want
    assert values(shingle_join.keep_one_of_each(more)) == want
    plain = docs.drop("lang").withColumn("v", F.lit(3))
    assert {(r.rid, r.v) for r in repeated_passages.drop_repeats(plain).collect()} == {("rid", 3)}
    chat = spark.createDataFrame([(1, '{"prompt": "hi", "response": "yo"}', 5)], "i int, j string, v int").withColumn("record", F.parse_json("j"))
    assert chat_format.format_chats(chat).first().v == 5


def test_exact_groups(docs, empty):
    want = {}
    for r in docs.collect():
        want.setdefault(r.text or "", []).append(r.doc_id)
    got = exact_dedup.exact_groups(docs, block=8, seed=4).collect()
    assert len(got) == docs.count() and sum(r.kept for r in got) == len(want)
    for r in got:
        own = want[r.text or ""]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == sorted(want)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_block_names_are_collision_free(spark):
    texts = [b"", b"ab", b"abab", b"ababab", b"abab", b"ba", b"abba", b"baab", b"ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, bytes binary")
    got = {r.rid: r.identity for r in exact_dedup.block_names(rows, 2).collect()}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(texts[i]) == len(texts[j]):
            assert (got[i] == got[j]) == (texts[i] == texts[j])


def test_language_id(spark):
    texts = [(i, queries.table(spark, SF, "documents").where("lang is not null").select("text", "lang").collect()[i]) for i in range(200)]
    df = spark.createDataFrame([(i, r.text, r.lang) for i, r in texts], "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id % 4 <> 2"))
    got = language_id.predict(df, model).where("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edge_cases(docs, empty):
    model = language_id.train(docs)
    got = language_id.predict(docs, model).collect()
    assert len(got) == docs.count() and all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert language_id.train(empty) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def letters_of(spark, text="the worthless idiot and the moron met a stupid clown"):
    return toxicity.character_model(spark.createDataFrame([(" ".join([text] * 50),), (None,)], "text string")).ravel().tolist()


def test_deobfuscation(spark):
    letters = letters_of(spark)
    for seen, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("iiidiot", "idiot"), ("cl0wn", "clown"), ("$tupid", "stupid"), ("st*pid", "stupid")):
        assert word in toxicity.all_words(f"a {seen} here", letters, {}), seen
    assert toxicity.all_words("Plain words, and Ünicode.", letters, {}) == {"plain", "words", "and", "ünicode"}


def test_best_path_against_all_paths():
    r = random.Random(1)
    model = [-5 * r.random() for _ in range(toxicity.LETTERS**3)]
    for _ in range(600):
        word = "".join(r.choice("aabbcls$10!|*é-") for _ in range(r.randint(1, 7)))
        costs = {}
        for path in itertools.product(*toxicity.lattice(word)):
            a = b = 0
            cost = sum(own for _, _, own in path)
            for k in [k for k, letters, _ in path for _ in letters] + [0]:
                cost -= model[(a * toxicity.LETTERS + b) * toxicity.LETTERS + k]
                a, b = b, k
            name = "".join(letters for _, letters, _ in path)
            costs[name] = min(cost, costs.get(name, cost))
        assert costs[toxicity.restore(word, model)] == pytest.approx(min(costs.values())), word


def test_long_disguised_words_are_decoded(spark):
    letters = letters_of(spark)
    assert "stupid" in toxicity.all_words("a st" + "u" * 60 + "pid", letters, {})
    assert {"worthless", "idiot", "moron", "clown", "stupid"} <= toxicity.all_words("w0rthl3ss,1d10t,m0r0n,cl0wn.$tup1d_m0r0n;1d10t", letters, {})
    assert "moron" in toxicity.all_words("m0r0n," * 20_000, letters, {})


def test_long_texts_take_linear_time(spark):
    r, letters = random.Random(2), letters_of(spark)
    model = toxicity.Model(letters, {"idiot": 9.0}, -3.0)
    for text in ("".join(r.choice("abcdefgh") for _ in range(70_000)), "漢字" * 35_000, "a" + "*" * 70_000 + "b", "a . " * 20_000, "1l|" * 10_000, " " * 70_000, "a* " * 30_000 + "ab"):
        begin = time.monotonic()
        assert model.score(text) < 0.5 < model.score(text + " 1d10t")
        assert time.monotonic() - begin < 10


def test_all_combinations_of_disguise(spark):
    letters = letters_of(spark)
    signs = {"idiot": ("idiot", "1d107", "1diot", "idi0t"), "stupid": ("stupid", "$tup1d", "5tup1d"), "moron": ("moron", "m0r0n", "mor0n")}
    for word, forms in signs.items():
        for form, gap, double in itertools.product(forms, ("", " ", "  ", ".", "-", " . ", "*", "\n"), (1, 2, 3)):
            seen = gap.join(c * double if not gap else c for c in form) if not gap or double == 1 else gap.join(form[0] * double + form[1:])
            if seen != word:
                assert word in toxicity.all_words(f"you {seen} there", letters, {}), seen
    for seen, word in (("a55", "ass"), ("a$$", "ass"), ("iddiioott", "idiot"), ("1 d 1 0 t", "idiot"), ("s t u p 1 d", "stupid"), ("s t * p i d", "stupid")):
        assert word in toxicity.all_words(f"the {seen} here", letters_of(spark, "the ass and the idiot are stupid"), {}), seen


def test_model_does_not_depend_on_the_partitions(spark):
    # A word as common in clean rows as in toxic ones is no feature, however few rows a task has.
    rows = [(i, f"{prose(12, i)} " + ("ordinary " if i % 3 == 0 else "") + ("moronic" if i % 10 == 0 else ""), int(i % 10 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    one, *more = (toxicity.train(df.repartition(n), df.select("doc_id", "toxic")) for n in (1, 13, 97))
    assert all(m == one for m in more) and "moronic" in one.weights and "ordinary" not in one.weights


def test_toxicity_keeps_foreign_columns(spark, docs):
    model = toxicity.train(docs, spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int"))
    kept = toxicity.drop_toxic(docs.withColumns({"score": F.lit(42.0), "y": F.lit(5)}), model)
    assert {(r.score, r.y, r.predicted) for r in kept.collect()} == {(42.0, 5, "predicted")}


def test_toxicity(spark, docs, empty):
    r = random.Random(4)
    rows = []
    for i in range(600):
        words, toxic = prose(40, i).split(), i % 5 == 0
        if toxic:
            bad = r.choice(["idiot", "moron", "worthless"])
            words[r.randrange(40)] = bad if i % 2 else bad.replace("o", "0")
        rows.append((i, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic").where("doc_id % 3 <> 0"))
    got = toxicity.score(df, model).where("doc_id % 3 = 0").collect()
    assert sum(x.predicted == x.toxic for x in got) >= 0.97 * len(got)
    out = toxicity.score(docs, model)
    assert out.count() == docs.count() and toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, df.select("doc_id", "toxic").where("doc_id = -1"))
    assert {x.predicted for x in toxicity.score(docs, none).collect()} == {0}


def test_layouts_become_turns(spark):
    rows = [
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "id": 1}',
        '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": null}]}',
        '{"conversations": [{"from": "user", "value": "hi"}]}',
        '{"prompt": "hi", "response": "yo"}', '{"completion": "yo", "prompt": "hi"}',
        '{"instruction": "do", "input": "this", "output": "done"}', '{"instruction": "do", "input": "", "output": "done"}',
        '{"other": 1}', None,
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string").withColumn("record", F.parse_json("j"))
    got = {r.i: (r.layout, [tuple(t) for t in r.turns] if r.turns is not None else None) for r in chat_format.canonical_turns(df, "record").collect()}
    assert got[1] == ("messages", [("user", "hi"), ("assistant", "")])
    assert got[2] == ("from_value", [("user", "hi")])
    assert got[3][1] == got[4][1] == [("user", "hi"), ("assistant", "yo")]
    assert got[5][1] == [("user", "do\nthis"), ("assistant", "done")] and got[6][1] == [("user", "do"), ("assistant", "done")]
    assert got[0] == got[7] == got[8] == (None, None)


def test_formatted_chats_read_back(spark):
    nasty = ["", "\\", "\\### Assistant: </turn> ok", "<turn>### a: b</turn>\n", "\\b\\l\\h\\c", "a:b#c<d", "é\n\n", None]
    rows = [(c, t, role, x) for c in (1, None) for t, (role, x) in enumerate(itertools.product(["user", "assistant", "we:ird\\", None], nasty))] + [(1, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(chat_format.records_of_rows(df)).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 2
    for r in out:
        want = sorted((t, role or "", x or "") for c, t, role, x in rows if c == r.id)
        assert [(t.role, t.text) for t in r.back] == [w[1:] for w in want]
        assert r.loss == "".join(w[2] for w in want if w[1] == "assistant")
    assert chat_format.format_chats(chat_format.records_of_rows(df.where("turn = -1"))).count() == 0


def encodings(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    return [e.ids for e in library.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_token_counts(docs, empty):
    rows = docs.collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(e)) for r, e in zip(rows, encodings([r.text for r in rows]))), key=repr)
    got = token_counts.count_tokens(docs, queries.tokenizer_path, huge=600, chunk=256, overlap=32)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert token_counts.count_tokens(empty, queries.tokenizer_path).count() == 0


def test_pieces_give_the_library_ids(monkeypatch):
    from kinetrack.llm import tokens

    r, signs = random.Random(8), list("abcXYZéßÿ×÷ 0123 \n\t.,;'s'll!?<|>-_\xa0\u3000\u2003\u2019\x1cд漢\x00") + ["<|endoftext|>", " don't ", "  ", "x" * 70, "été,"]
    for remember in (tokens.REMEMBER, 300):
        monkeypatch.setattr(tokens, "REMEMBER", remember)
        own = tokens.Encoder(queries.tokenizer_path())
        for _ in range(4):
            texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)]
            raw = [t.encode() for t in texts]
            codes, parts = own.codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            at = 0
            for t, n, want in zip(texts, parts, encodings(texts)):
                got = [i for c in codes[at : at + n] for i in own.ids[own.start[c] : own.start[c] + own.count[c]]]
                assert got == want, t
                at += n


def test_packing(docs, empty):
    rows = docs.select("doc_id", "text").where("doc_id is not null and doc_id <> 3").collect()
    ids = {r.doc_id: [*e, 1] for r, e in zip(rows, encodings([r.text for r in rows]))}
    got = packing.pack_documents(docs.where("doc_id <> 3"), queries.tokenizer_path, limit=256, block=1000).collect()
    seen, sequences = {i: 0 for i in ids}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(docs, queries.tokenizer_path).groupBy().sum("length").first()[0] == sum(len(e) + 1 for e in encodings([r.text for r in docs.collect()]))
    assert packing.pack_documents(empty, queries.tokenizer_path).count() == 0


def test_cuts_are_optimal():
    r = random.Random(6)
    for _ in range(200):
        places = sorted(r.sample(range(1, 60), 12)) + [60]
        if max(b - a for a, b in zip([0, *places], places)) > 20:
            continue
        penalties = [r.choice([0, 3, 9]) for _ in places]

        def cost(cuts):
            spans = list(zip([0, *cuts], cuts))
            if any(b - a > 20 for a, b in spans):
                return None
            return sum(20 - (b - a) + penalties[places.index(b)] for a, b in spans[:-1])

        best = min(c for k in range(len(places)) for own in itertools.combinations(places[:-1], k) if (c := cost([*own, 60])) is not None)
        assert cost(packing.choose_cuts(places, penalties, 20)) == best


def brute_hits(text, items, window):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    w, hit, names = words(text), set(), set()
    places = {}
    for p, x in enumerate(w):
        places.setdefault(x, []).append(p)
    for name, t in items:
        own = words(t)
        for k in range(max(1, len(own) - window + 1) if own else 0):
            part = own[k : k + window]
            for p in places.get(part[0], ()):
                if w[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    names.add(name)
    return len(w), len(hit), sorted(names)


def test_decontamination(spark, docs, empty):
    items = [("10", prose(300, 1)[:400]), ("9", PASSAGE[30:200]), ("2", "two words"), ("3", "!!"), ("4", None), ("9", "Word"), ("5", "the " * 12)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    small = docs.where("doc_id not in (20, 21, 22)")
    for block in (4_000_000, 200):
        got = decontaminate.hits(decontaminate.matches(small, bench, block_chars=block)).collect()
        assert len(got) == small.count()
        for r in got:
            assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items, 10), r.doc_id
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.hits(decontaminate.matches(docs, bench.where("item_id = 'x'"))).where("contaminated").count() == 0


def test_longest_match_and_place(spark):
    item = prose(40, 50)
    df = spark.createDataFrame([(1, "zz yy " + " ".join(item.split()[5:20]) + " qq")], "doc_id long, text string")
    spans = decontaminate.matches(df, spark.createDataFrame([("a", item)], "item_id string, text string")).first().spans
    assert max((s.end - s.start, s.start) for s in spans) == (15, 2)
    long = prose(900, 51)
    df = spark.createDataFrame([(1, "zz " + " ".join(long.split()[100:800]) + " qq"), (2, long)], "doc_id long, text string")
    found = {r.doc_id: max(s.end - s.start for s in r.spans) for r in decontaminate.matches(df, spark.createDataFrame([("a", long)], "item_id string, text string")).collect()}
    assert found == {1: 700, 2: 900}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    known, bench = docs.columns, queries.table(spark, SF, "benchmark").collect()
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, written(stage(spark, kept, SF))
        assert kept.columns == known and kept.count() < before.count() or name == "decontamination"
    rows = kept.collect()
    texts = [r.text for r in rows]
    assert len(set(texts)) == len(texts)
    sets = brute_sets(texts)
    assert len(set(components(list(range(len(rows))), sets).values())) == len(rows)
    assert not any(brute_hits(t, [(str(b.item_id), b.text) for b in bench], 10)[1] for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.groupBy().sum("length").first()[0] == sum(len(e) + 1 for e in encodings(texts))


def test_digest_is_of_the_text(spark):
    got = {r.doc_id: r.text_sha256 for r in queries.op4_exact_dedup(spark, SF).collect()}
    assert all(got[r.doc_id] == hashlib.sha256((r.text or "").encode()).hexdigest() for r in queries.table(spark, SF, "documents").collect())


def packed_as_stated(got, want):
    """Pieces hold each id of each document once, in order; sequences are gapless and 2048 long or a power of two, but for their padding. ``want``: id -> the documents' ids."""
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(want)
    for i, own in by_doc.items():
        left = sorted(want[i], key=len)
        assert sum(r.length for r in own) == sum(map(len, left)) and all(r.length > 0 and r.doc_tokens in set(map(len, left)) for r in own)
        if len(left) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(left[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        lengths.append(at)
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding <= 0.1 * sum(lengths) + 2048 * 64


def plain_runs(words, least=12):
    """Maximal runs by comparing each word with the one a period before."""
    out = []
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i - q] for i in range(q, len(words))] + [False]
        begin = None
        for i, s in enumerate(same):
            if s and begin is None:
                begin = i
            elif not s and begin is not None:
                length = i - begin + q
                if length >= max(least, 2 * q) and not any(q % p == 0 and all(words[k] == words[k - p] for k in range(begin + p, begin + length)) for p in range(1, q)):
                    out.append((begin, length, q))
                begin = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return len(runs), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


CONTRACTS = {
    "op1_jaccard_join": "doc_id n_shingles component_id",
    "op2_repeated_passages": "doc_id start_word n_words partner_id partner_start partner_words similarity keeps class_id",
    "op3_histogram_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op5_language_id": "doc_id held_out lang_pred score",
    "op6_toxicity": "doc_id held_out score predicted",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op10_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op11_bpe_round_trip": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_registered_queries(spark, name):
    """Each query without SQL over its whole table, its columns and their values."""
    rows = queries.table(spark, SF, "documents").collect()
    df = queries.QUERIES[name](spark, SF)
    assert set(CONTRACTS[name].split()) <= set(df.columns)
    got = df.collect()
    by_id = {r.doc_id: r for r in got}
    texts = {r.doc_id: r.text or "" for r in rows}
    crc = lambda i: zlib.crc32(str(i).encode())
    if name not in ("op2_repeated_passages", "op8_packing"):
        assert sorted(r.doc_id for r in got) == sorted(texts)
    if name == "op1_jaccard_join":
        sets = brute_sets([r.text for r in rows])
        names = components([r.doc_id for r in rows], sets)
        assert all((by_id[r.doc_id].n_shingles, by_id[r.doc_id].component_id) == (len(sets[k]), names[k]) for k, r in enumerate(rows))
    elif name == "op3_histogram_shards":
        assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 16 and r.size == len(texts[r.doc_id].encode()) + 1 for r in got)
        assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
        total, largest = sum(r.size for r in got), max(r.size for r in got)
        for shard in range(16):
            own = [r for r in got if r.shard == shard]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            assert abs(sum(r.size for r in own) - total / 16) <= 0.02 * total / 16 + 2 * largest
    elif name == "op5_language_id":
        lang = {r.doc_id: r.lang for r in rows}
        assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
        held = [r for r in got if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    elif name == "op6_toxicity":
        marks = {r.doc_id: r.toxic for r in queries.table(spark, SF, "labels").collect()}
        assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
        held = [r for r in got if r.held_out and marks.get(r.doc_id) is not None]
        assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.9 * len(held)
    elif name == "op8_packing":
        packed_as_stated(got, {i: [[*e, 1]] for i, e in zip(texts, encodings(list(texts.values())))})
    elif name == "op9_token_counts":
        want = dict(zip(texts, map(len, encodings(list(texts.values())))))
        assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts[r.doc_id].encode()), want[r.doc_id] > 512) for r in got)
    elif name == "op11_bpe_round_trip":
        want = dict(zip(texts, encodings(list(texts.values()))))
        for r in got:
            ids = ",".join(map(str, want[r.doc_id]))
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    elif name == "op13_periodic_runs":
        for r in got:
            assert tuple(r) == (r.doc_id, *brute_digest(r.doc_id, texts[r.doc_id]))
    elif name == "op10_decontaminate":
        items = [(str(b.item_id), b.text) for b in queries.table(spark, SF, "benchmark").collect()]
        for r in got:
            n, hit, found = brute_hits(texts[r.doc_id], items, 10)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


def test_passages_against_all_pairs(spark):
    """Exact repeats of 50 words are all found, near ones mostly, and nothing else."""
    r, rows = random.Random(21), []
    passages = [[f"p{k}w{r.randrange(10**6)}" for _ in range(r.choice((50, 55, 70, 120)))] for k in range(12)]
    for i in range(80):
        words = [f"d{i}w{r.randrange(10**6)}" for _ in range(r.randint(20, 90))]
        for _ in range(r.choice((0, 1, 1, 2))):
            own = list(passages[min(r.randrange(12), r.randrange(12))])
            if r.random() < 0.4 and len(own) >= 70:
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            at = r.randrange(len(words))
            words[at:at] = own
        rows.append((i, " ".join(words)))
    tokens = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in ((i, t.split()) for i, t in rows)}
    exact, near = set(), set()
    for i, j in itertools.combinations(tokens, 2):
        place = {t: k for k, t in enumerate(tokens[j])}
        run, by_diagonal = 0, {}
        for k, t in enumerate(tokens[i]):
            p = place.get(t)
            run = run + 1 if p is not None and run and place.get(tokens[i][k - 1]) == p - 1 else int(p is not None)
            if run >= 46:
                exact |= {i, j}
            if p is not None:
                by_diagonal.setdefault(k - p, []).append(k)
        # Near: on one diagonal a span of 46 tokens or more with a similarity of 0.8.
        for own in by_diagonal.values():
            if any(own[b] - own[a] >= 45 and 5 * (b - a + 1) >= 4 * (2 * (own[b] - own[a] + 1) - (b - a + 1)) for a in range(len(own)) for b in range(a + 44 if a + 44 < len(own) else a, len(own))):
                near |= {i, j}
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {x.doc_id for x in got}
    assert exact <= found and found <= exact | near
    assert len(found & near) >= 0.9 * len(near)
    group = {x.doc_id: x.class_id for x in got}
    assert all(group[x.doc_id] == group[x.partner_id] <= x.doc_id for x in got)


def test_packing_spreads_one_id(spark, docs, empty):
    """Thousands of rows without an id, many of them equal, are not left to one task."""
    rows = [(None, f"text {i % 40} " * 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df, queries.tokenizer_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    packed_as_stated(got.collect(), {None: [[*e, 1] for e in encodings([t for _, t in rows])]})
    assert packing.pack_documents(empty, queries.tokenizer_path).count() == 0


def test_bpe_round_trip(spark, docs, empty):
    want = sorted(((r.doc_id, e, r.text or "") for r, e in zip(docs.collect(), encodings([r.text for r in docs.collect()]))), key=repr)
    for words in (0, 7, 65_536):
        got = bpe.encode(docs, queries.tokenizer_path, words=words, decoded=True)
        assert sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=repr) == want
    assert bpe.encode(empty, queries.tokenizer_path).count() == 0


def test_merges_and_decoding_are_the_library_s(spark):
    from tokenizers import Tokenizer

    library, m, r = Tokenizer.from_file(queries.tokenizer_path()), bpe.Merger(queries.tokenizer_path()), random.Random(6)
    signs = [*"abcdefghijABC   '.,!?\n\t12_", "é", "ß", "中", "<|endoftext|>", "'ll", "\xa0", "😀", "٣", "x" * 100, "№"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(400)] + ["ab" * 5000]
    assert all(m.encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)
    plain = [w for t in texts for w in re.findall(r" ?[a-zA-Z]+", t)]
    assert m.merge_many([w.encode() for w in plain]) == [library.encode(w).ids for w in plain]
    lists = [None, [], [-1], [10**6], *([r.randrange(50257) for _ in range(r.randint(1, 20))] for _ in range(50))]
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(lists)], "id long, ids array<int>, decoded string")
    got = {x.id: x.decoded for x in bpe.decode(df, queries.tokenizer_path).collect()}
    assert got == {i: library.decode([k for k in x or () if 0 <= k < 50257], skip_special_tokens=False) for i, x in enumerate(lists)}


def test_lexicon_is_a_minimal_automaton():
    r = random.Random(8)
    words = sorted({bytes(r.choice(b"abcd") for _ in range(r.randint(0, 7))) for _ in range(2000)})
    edges, final = lexicon.minimal_automaton(words)
    below: dict[frozenset, int] = {}
    for state in range(len(edges)):
        endings = {b""} if final[state] else set()
        for byte, to, _ in edges[state]:
            endings |= {bytes([byte]) + e for e in ends[to]}
        ends = (ends if state else {}) | {state: endings}
        assert below.setdefault(frozenset(endings), state) == state, "two states accept the same endings"
    assert ends[len(edges) - 1] == set(words)
    compiled = lexicon.Lexicon(np.frombuffer(lexicon.compile_lexicon({w: [k] * (k % 3) for k, w in enumerate(words)}), np.int32))
    asked = words + [bytes(r.choice(b"abcde") for _ in range(r.randint(0, 9))) for _ in range(3000)]
    size = np.array([len(w) for w in asked])
    number = compiled.find(np.frombuffer(b"".join(asked) + b"\0", np.uint8), np.cumsum(size) - size, size)
    known = {w: k for k, w in enumerate(words)}
    assert number.tolist() == [known.get(w, -1) for w in asked]
    assert all(compiled.ids[compiled.first[k] : compiled.first[k + 1]].tolist() == [k] * (k % 3) for k in range(len(words)))


def test_periodic_runs(spark, docs, empty):
    r = random.Random(9)
    rows = []
    for i in range(150):
        words = [r.choice("abcde"[: r.choice((1, 2, 3, 5))]) for _ in range(r.randint(0, 70))]
        if words and r.random() < 0.6:
            a = r.randrange(len(words))
            p = 1 + (len(words) - a) // r.randint(2, 9)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
        rows.append((i, r.choice((" ", "\n", "  ")).join(words)))
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(2), docs.where("doc_id is null or doc_id not in (21, 22)")):
        texts = sorted(((x.doc_id, x.text or "") for x in df.collect()), key=repr)
        got = sorted(((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in periodic_runs.periodic_runs(df).collect()), key=repr)
        want = []
        for i, t in texts:
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            runs = plain_runs(words)
            gone = {k for s, length, q in runs for k in range(s + q, s + length)}
            want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
        assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(empty).count() == 0
    begin = time.monotonic()
    one = periodic_runs.periodic_runs(spark.createDataFrame([(1, "the " * 200_000), (2, " ".join(r.choice("ab") for _ in range(100_000)))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(x) for x in one[0].runs] == [(0, 200_000, 1)] and one[0].collapsed == "the" and time.monotonic() - begin < 60


def test_words_with_equal_hashes_are_compared():
    from kinetrack.llm import words as W

    raw = b" ".join(b"w%d" % i for i in range(24))
    w = W.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), W.SPACED, lower=False)
    w.hash = np.tile(w.hash[:4], 6)
    assert not len(periodic_runs.word_runs(w)[0])


def plain_collocations(rows, least, top, longest=5):
    counts, total = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            total[lang] = total.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    good = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = {}
    for (lang, w), n in good.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(n, inside.get((lang, w[i : i + k]), 0))
    out = []
    for (lang, w), a in good.items():
        if inside.get((lang, w), 0) < a:
            n = total[lang]
            score, k = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]], n))
    ranked, seen = [], {}
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


@pytest.mark.parametrize(("bits", "top"), [(27, 2000), (3, 2000), (27, 5)])
def test_collocations(spark, docs, empty, monkeypatch, bits, top):
    """Also with tables of eight bits, where all fingerprints look frequent."""
    monkeypatch.setattr(phrases, "BITS", bits)
    r = random.Random(13)
    few = VOCABULARY[:12]
    rows = [(i, r.choice(("en", "de", None)), "".join(r.choice(few) + r.choice(("  ", " ", " ", " ", "\t", ". ", "\n", "; ")) for _ in range(r.randint(0, 120)))) for i in range(120)]
    rows += [(500 + i, "en", "Strong Tea is  strong tea, and über den wolken naïve") for i in range(30)] + [(900, None, None), (901, "fr", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4).withColumns({c: F.lit(c) for c in ("n", "phrase", "salt", "rank")})
    got = phrases.collocations(df, least=20, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == sorted(plain_collocations([x[1:] for x in rows], 20, top)) and len(got) > 4
    if top == 5:
        assert phrases.collocations(empty).count() == 0 and phrases.frequent_phrases(empty).count() == 0


def test_equal_fingerprints_are_told_apart_by_the_text(spark, monkeypatch):
    """With fingerprints that are all equal the phrases and their counts are still those of the text."""
    monkeypatch.setattr(phrases.Stretches, "prints", lambda self, at, k, salt: np.full(len(at), 1 << 63, np.uint64))
    texts = [("en", "a b c. a b. c c c c"), ("de", "a b"), ("en", "b c c")]
    import pyarrow as pa

    class Bits:
        value = np.full(1 << 24, 255, np.uint8)

    batch = pa.record_batch([pa.array([x for x, _ in texts]), pa.array([1, 2, 1], pa.int64()), pa.array([t for _, t in texts])], names=["lang", "salt", "text"])
    rows = pa.Table.from_batches(list(phrases._spell(Bits, Bits, Bits, 5, 6)(iter([batch]))))
    got = {(x["lang"], x["phrase"]): x["n"] for x in phrases._add_up(1)(rows).to_pylist()}
    assert got["en", "c c"] == 4 and got["en", "a b"] == 2 and got["de", "a b"] == 1 and got["en", "b c"] == 2 and got["en", "c"] == 7 and got["en", ""] == 12 and got["de", ""] == 2


def test_conversations_of_all_layouts_read_back(spark):
    """Dealt over four layouts, conversations keep their turns."""
    rows = [(i, t, r, x) for i in [*range(-8, 40)] for t, (r, x) in enumerate([("user", f"a {i} <turn>"), ("assistant", f"b: {i} \\#")][: 1 + i % 3] + [("user", None)] * (i % 5 == 4))]
    df = spark.createDataFrame([*rows, (None, 0, "user", "lost")], "conv_id long, turn int, role string, text string")
    out = chat_format.format_chats(chat_format.records_of_rows(df, mixed=True)).select("id", "layout", chat_format.read_back(F.col("formatted")).alias("back")).collect()
    assert {r.layout for r in out} == {"messages", "from_value", "prompt_response", "turns"}
    want = {}
    for i, _, r, x in rows:
        want.setdefault(i, []).append((r, x or ""))
    assert {r.id: [(t.role, t.text) for t in r.back] for r in out if r.id is not None} == want


def test_near_passages_alone(spark):
    """Recall of pairs that share a passage only with changed words, and no 50 words in a row: all pairs are known."""
    r, rows = random.Random(41), []
    for k in range(150):
        passage = [f"p{k}w{r.randrange(10**6)}" for _ in range(r.randint(100, 140))]
        other = list(passage)
        for at in range(r.randint(35, 48), len(other), r.randint(38, 48)):
            other[at] = f"e{r.randrange(10**9)}"
        for words in (passage, other):
            own = [f"d{len(rows)}w{r.randrange(10**6)}" for _ in range(r.randint(10, 200))]
            at = r.randrange(len(own))
            rows.append((len(rows), " ".join([*own[:at], *words, *own[at:]])))
    got = repeated_passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = {(min(x.doc_id, x.partner_id), max(x.doc_id, x.partner_id)) for x in got}
    assert found <= {(i, i + 1) for i in range(0, 300, 2)}
    assert len(found) >= 0.95 * 150, len(found)


def test_language_features_are_plain_counts():
    texts = ["", "a", "The the", "Ünï çödé", prose(40, 3).upper(), "xy" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    got = language_id.features(data, offsets, 256)
    for row, text in zip(got, texts):
        low, counts = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()), [0] * 256
        for order in (1, 2, 3):
            for i in range(len(low) - order + 1):
                gram = 0
                for c in low[i : i + order]:
                    gram = (gram * 257 + c + 1) % 2**32
                counts[((gram * 2654435761 + order * 97) % 2**32) >> 24] += 1
        assert np.allclose(row, [(c / max(1, sum(counts))) ** 0.5 for c in counts], atol=1e-6)


def test_duels_are_counted_one_by_one():
    r = np.random.default_rng(3)
    duels = language_id.Duels(["a", "b", "c", "d"], list(itertools.combinations(range(4), 2)), r.normal(size=(6, 6)).astype(np.float32))
    x = r.normal(size=(200, 5)).astype(np.float32)
    best, trust = duels.decide(x)
    for k, row in enumerate(x):
        wins, least = [0.0] * 4, [1.0] * 4
        for (a, b), w in zip(duels.pairs, duels.weights.T):
            p = 1 / (1 + np.exp(-4 * float(row @ w[:-1] + w[-1])))
            wins[a], wins[b] = wins[a] + (p >= 0.5) + p / 1000, wins[b] + (p < 0.5) + (1 - p) / 1000
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        winner = max(range(4), key=wins.__getitem__)
        assert best[k] == winner and trust[k] == pytest.approx(least[winner], abs=1e-5)


def test_toxicity_scores_are_sums_over_restored_words(spark):
    letters = letters_of(spark, "you stupid moron and idiot are here")
    weights = {"idiot": 2.5, "idio*": 0.25, "stupid": 1.75, "moron": 1.0, "here": 0.5}
    model = toxicity.Model(letters, weights, -3.0)
    for text in ("", "you are here", "you 1d10t", "s t u p 1 d moron here here", "idiotic m0r0n!!", "STUPID " * 50, "i.d.i.o.t", "nothing at all"):
        words = toxicity.all_words(text, letters, {})
        found = {f for w in words for f in toxicity.features_of(w)}
        want = 1 / (1 + np.exp(3.0 - sum(v for f, v in weights.items() if f in found)))
        assert model.score(text) == pytest.approx(want), text
    # Counts of features over the labelled rows, against plain counting.
    rows = [(1, ["idiot", "you"]), (1, ["idiot", "idiots"]), (0, ["you"]), (0, []), (1, [])]
    df = spark.createDataFrame(rows, "y int, words array<string>").repartition(3)
    got = df.mapInArrow(toxicity._count_features, "feature string, t long, n long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect()
    plain = {}
    for y, words in rows:
        for f in {f for w in words for f in toxicity.features_of(w)}:
            t, n = plain.get(f, (0, 0))
            plain[f] = (t + y, n + 1)
    assert {r.feature: (r.t, r.n) for r in got} == plain
