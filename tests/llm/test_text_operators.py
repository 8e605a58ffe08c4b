"""Operators on documents against brute force and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vellumite.llm import bpe, jaccard, language, lattice, packing, queries, toxicity, words
from vellumite.llm.components import components
from vellumite.llm.store import Scratch

DATA = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, score double"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def grams(text, width):
    w = tokens(text)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def corpus(seed=1, n=60):
    """Texts with copies, near copies, a shared passage, odd rows and one long text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaonish") for _ in range(rng.randint(1, 7)))
    shared = " ".join(word() for _ in range(60))
    texts = []
    for k in range(n):
        w = [word() for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(w) + (" " + shared if k % 3 == 0 else ""))
        if k % 4 == 0:
            for _ in range(rng.randint(1, 4)):
                w2 = list(w)
                for _ in range(rng.randint(0, 3)):
                    w2[rng.randrange(len(w2))] = word()
                texts.append(" ".join(w2).upper())
    texts += [None, "", " \n\t", "one", "one two", "One TWO", "é ü\u00a0x \x1c y", " ".join(word() for _ in range(20_000))]
    return [(k, t) for k, t in enumerate(texts)]


#: Usual; with frequent n-grams that tie, not pair, few counters and tiles of some sets.
@pytest.mark.parametrize("p", [jaccard.Parameters(), jaccard.Parameters(5, 80), jaccard.Parameters(4, 85, 64, 1, 40, 2), jaccard.Parameters(5, 80, 1 << 12, 3, 100, 3, 500, 0), jaccard.Parameters(2, 60, 1 << 16, 4, 50, 8, 1 << 12)])
def test_jaccard_join_is_exact(spark, p):
    rows = corpus()
    width, percent = p.width, p.percent
    sets = {i: grams(t, width) for i, t in rows}
    parent = {i: i for i in sets}
    links = Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            u, v = sorted((root(a), root(b)))
            parent[v] = u
    docs = spark.createDataFrame([(i, t, None, 1.0) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in jaccard.join(docs, p).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: root(i) for i in sets}
    assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in sets}


def test_jaccard_join_moves_no_sets_for_its_choices(spark, monkeypatch):
    """Where large blocks are tied anew, and where members are more than one broadcast takes, the sets of all rows stay where they are."""
    p = jaccard.Parameters(4, 85, 64, 1, 40, 2, most_broadcast=60)
    texts = [" ".join(f"w{(k // 4) * 7 % 13 + j}" for j in range(30)) + f" end{k}" for k in range(120)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    plans = []
    for name in ("_classes", "_compared"):
        monkeypatch.setattr(jaccard, name, lambda df, p, f=getattr(jaccard, name), name=name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), f(df, p))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, p).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sets = [{tuple(t.split()[k : k + 4]) for k in range(28)} for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root)) and len(set(root)) < len(root)
    names = [name for name, _ in plans]
    assert names.count("_classes") > 1 and names.count("_compared") > 1
    assert not any("SortMergeJoin" in plan or "ShuffledHashJoin" in plan for _, plan in plans)


@pytest.mark.parametrize("p", [jaccard.Parameters(4, 85, few=3, tile_sets=16), jaccard.Parameters(5, 80, few=3, tile_sets=16)])
def test_jaccard_join_of_ngrams_that_many_unlike_texts_share(spark, monkeypatch, p):
    """Passages each shared by more texts than ``few``, otherwise unlike, make no block of all texts; and no table holds the sets."""
    rng, n = random.Random(3), 120
    passages = [" ".join(f"p{k}w{j}" for j in range(8)) for k in range(60)]
    texts = []
    for k in range(n):
        parts = [f"t{k}x{j}" for j in range(25 + k // 4)] + rng.sample(passages, 4)
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += [t + " more" for t in texts[:10]]
    moved, written = [], []
    monkeypatch.setattr(jaccard, "_compared", lambda df, p, f=jaccard._compared: (moved.append(df.count()), f(df, p))[1])
    monkeypatch.setattr(Scratch, "write", lambda self, df, name, f=Scratch.write: (written.extend(df.columns), f(self, df, name))[1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), p).collect()}
    assert got == {k: k - n if k >= n else k for k in range(len(texts))}
    assert sum(moved) < len(texts) and "grams" not in written


def test_jaccard_join_compares_a_large_block_in_parts(spark, monkeypatch):
    """What a block of many tiles moves is bounded at each time, and every pair of tiles is compared once."""
    p = jaccard.Parameters(4, 85, tile_sets=2, moved=1 << 10)
    texts = [" ".join(f"w{j}" for j in range(60)) + f" end{k}" for k in range(40)] + [" ".join(f"v{j}" for j in range(30)) + f" end{k % 2}" for k in range(3)]
    moved, pairs = [], Counter()

    def compared(df, p, f=jaccard._compared):
        moved.append(df.agg({"n": "sum"}).first()[0] * 8)
        pairs.update(tuple(r) for r in df.select("block", "low", "high").distinct().collect())
        return f(df, p)

    monkeypatch.setattr(jaccard, "_compared", compared)
    got = {r["doc_id"]: (r["component_id"], r["n_links"]) for r in jaccard.join(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), p).collect()}
    assert got == {k: (0, 39) if k < 40 else (40, 2) for k in range(43)}
    assert len(moved) > 4 and max(moved) < sum(moved) / 3 and set(pairs.values()) == {1}


def test_jaccard_join_of_odd_tables(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []
    linked = spark.createDataFrame([(1, "a b c d", None, 0.0), (5, "a b c d", None, 0.0), (5, "e f g h i", None, 0.0), (3, "e f g h i", None, 0.0), (2, "z", None, 0.0)], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(linked).collect()) == [(1, 1), (2, 2), (3, 1), (5, 1), (5, 1)]
    docs = spark.createDataFrame([(1, "a b c d", None, 0.0), (1, "a b c d", None, 0.0), (2, "a b c d", None, 0.0), (None, "a b c d", None, 0.0), (3, None, None, None)], SCHEMA)
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in jaccard.join(docs).where("doc_id is not null").collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_words_hash_alike_wherever_they_stand():
    texts = pa.array(["Aa  bb\tcc", None, "", "x AA bb cc é", "\x0bCC"])
    w = words.split(texts)
    assert list(np.diff(w.first)) == [3, 0, 0, 5, 1]
    a, b = w.hashes[:3], w.hashes[3:8]
    assert list(a) == list(b[1:4]) and w.hashes[8] == a[2] and len(set(w.hashes)) == 5
    sliced = words.split(texts.slice(3, 1))
    assert list(sliced.hashes) == list(b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()} == {x: root(x) for x in parent}
    assert components(df.where("u = 7 and v = 7"), Scratch(spark, "t")).collect() == []


ODD = ["", "  ", "Hello WORLD's don't I'LL 123 4½ ²x", "日本語 テスト ΣΑΣ ΟΔΟΣ İstanbul ǅ", "cafe\u0301 ̀x <|endoftext|> a<|startoftext|>B<|endoftext", "aaaaaaaaaaaaaaaaa ....!!!--- 's't", "\x1c\x1d a\x85b\xa0c 😀😀", "x" * 700, "ab" * 3000]


def odd_texts():
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz'0123456789 .,!éñßü中😀Σ\u0301\n<|") for _ in range(rng.randint(1, 150))) for _ in range(150)]
    return ODD + some + [" ".join("".join(rng.choice("etaonishr") for _ in range(rng.randint(1, 14))) for _ in range(40)) for _ in range(60)]


def test_automaton_is_the_tokenizer(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = [*odd_texts(), None]
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in bpe.digest(docs, WORD_BPE).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    decoded = bpe.decode(bpe.encode(docs, WORD_BPE, ["doc_id"]), WORD_BPE, ["doc_id"]).collect()
    assert all(sha(r["text"]) == got[r["doc_id"]]["decoded_sha256"] for r in decoded)
    assert bpe.digest(docs.limit(0), WORD_BPE).collect() == []


def test_small_automaton():
    # merges in order: aa, ab, aab: of a row of equal symbols the first two merge
    vocab = {x: k for k, x in enumerate(["a", "b", "a.", "b.", "aa", "ab", "aab"])}
    automaton = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")], ".").ready()
    assert [automaton.labels[t] for t in automaton.encode("aaaba")] == ["aa", "ab", "a."]
    with pytest.raises(ValueError):
        bpe.Automaton(vocab, [("aa", "b"), ("a", "a")], ".")


def test_packing(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = [*odd_texts(), None]
    docs = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], SCHEMA).repartition(3, "doc_id")
    window = 64
    pieces = packing.pack(docs, WORD_BPE, window=window).collect()
    full = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for k, ids in full.items():
        at = 0
        for p in sorted(by_doc[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    lengths = {}
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths[k] = at
    last = max(lengths)
    assert sorted(lengths) == list(range(last + 1)) and all(n == window for k, n in lengths.items() if k < last)
    n = lengths[last]
    assert {p["padded_length"] for p in by_sequence[last]} == {n if n & (n - 1) == 0 else window}
    assert packing.pack(docs.limit(0), WORD_BPE).collect() == []
    assert packing.pack(docs.where("text = ''"), WORD_BPE, end=None).collect() == []


def _language(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 3))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(2)
    letters = {"aa": ["ka", "lo", "mi"], "bb": ["tre", "sch", "ung"], "cc": ["ño", "que", "ar"]}
    rows = [(k, _language(rng, letters[lang], 60), lang, 0.0) for k, lang in enumerate(sorted(letters) * 12)]
    odd = [(100, None, "aa", 0.0), (101, "", None, 0.0), (102, "12 34 !!", "bb", 0.0), (103, "x", None, 0.0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    found = language.learn(docs)
    assert set(found) == set(letters)
    test = spark.createDataFrame([(k, _language(rng, letters[lang], 40), lang, 0.0) for k, lang in enumerate(sorted(letters) * 4)] + odd, SCHEMA)
    got = {r["doc_id"]: r for r in language.predict(test, found, ["doc_id"]).collect()}
    assert all(got[k]["lang_pred"] == lang and got[k]["accepted"] for k, lang in enumerate(sorted(letters) * 4))
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] in letters
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.predict(test, language.learn(docs.limit(0)), ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), found, ["doc_id"]).collect() == []


@pytest.mark.parametrize("text,words", [("½ ² Ⅷ 12 _", ""), ("नमस्ते, World!", "नमस्ते world"), ("Élan x²y", "élan x y"), ("\u0301", ""), ("", ""), ("日本2語", "日本 語")])
def test_letters_make_words(text, words):
    assert language.normalise(text) == words
    assert language.Classifier({"aa": b" a ", "bb": b" b "}, language.Parameters()).predict(text)[0] != "und" if words else True


def test_every_language_and_whole_texts_are_learned(spark):
    rows = [(k, f"wort{k:03d}x " * 900 + "zuletzt", f"l{k:03d}", 0.0) for k in range(90)] + [(5, "wieder", "l005", 0.0)]
    found = language.learn(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "n"))
    assert sorted(found) == sorted({lang for *_, lang, _ in rows}) and all(b" zuletzt " in x for x in found.values()) and b" wieder " in found["l005"]
    small = language.learn(spark.createDataFrame(rows, SCHEMA), language.Parameters(all_bytes=90 * 20))
    assert all(len(x) <= 20 for x in small.values()) and len(small) == 90


def test_languages_are_those_of_the_smallest_sizes(spark):
    """The query's rows against every text compressed with every dictionary, one by one."""
    import zstandard

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows}
    counts: dict = {}
    for r in rows:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"]:
            counts.setdefault(r["lang"], Counter()).update(re.findall(r"[^\W\d_²³¹¼½¾]+", r["text"].lower()))
    p, made = language.Parameters(), {}
    for lang, c in counts.items():
        raw = f" {' '.join(sorted(c, key=lambda w: (c[w], w)))} ".encode()[-p.dictionary_bytes :]
        how = zstandard.ZstdCompressionParameters.from_level(p.level, dict_size=len(raw), source_size=p.block_bytes, min_match=p.least_match, write_checksum=0, write_content_size=0, write_dict_id=0)
        made[lang] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
    got = {r["doc_id"]: r for r in queries.language_id(spark, DATA).collect()}
    assert len(got) == len(rows)
    right = []
    for r in rows:
        raw = " ".join(re.findall(r"[^\W\d_²³¹¼½¾]+", (r["text"] or "").lower())).encode()
        sizes = {lang: sum(len(c.compress(raw[k : k + p.block_bytes])) for k in range(0, len(raw), p.block_bytes)) for lang, c in made.items()}
        order = sorted(sizes, key=lambda x: (sizes[x], x))
        one = got[r["doc_id"]]
        assert one["held_out"] == held[r["doc_id"]] and one["lang_pred"] == (order[0] if raw else "und")
        assert one["accepted"] == (bool(raw) and sizes[order[1]] - sizes[order[0]] >= max(2, 0.02 * sizes[order[0]]))
        right += [one["lang_pred"] == r["lang"]] * (held[r["doc_id"]] and one["accepted"])
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)


def test_language_rejects_short_ties():
    found = {"aa": language.dictionary(Counter("kalo milo kami".split()), 1000), "bb": language.dictionary(Counter("trungsch schtre ungsch".split()), 1000)}
    both = language.Classifier(found, language.Parameters())
    assert [both.predict(x)[2] for x in ("x", "zzqxj wvyp", "kalo milo kami kalo kami")] == [False, False, True]
    one = language.Classifier({"aa": found["aa"]}, language.Parameters())
    assert [one.predict(x)[2] for x in ("x", "zzqxj wvyp", "kalo milo kami kalo kami")] == [False, False, True]


def test_toxicity(spark):
    rng = random.Random(4)
    clean = lambda: " ".join("".join(rng.choice("etaonish") for _ in range(rng.randint(2, 6))) for _ in range(40))
    rows, labels = [], []
    for k in range(400):
        bad = k % 5 == 0
        text = clean() + (" vileword! grimstem" + rng.choice("abcdefg") if bad else "")
        rows.append((k, text, None, 0.0))
        if k < 300:
            labels.append((k, int(bad)))
    rows += [(900, None, None, None), (901, "", None, None), (901, "", None, None), (902, clean() * 300, None, None)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    p = toxicity.Parameters(slots=1 << 18)
    model = toxicity.train(docs, marks, p)
    got = toxicity.score(docs, model, ["doc_id"], p).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if 300 <= r["doc_id"] < 400]
    right = [(r["score"] >= p.threshold) == (r["doc_id"] % 5 == 0) for r in held]
    assert sum(right) >= 0.97 * len(right), [(r["doc_id"], r["score"]) for r, ok in zip(held, right, strict=True) if not ok]
    assert all(r["score"] < p.threshold for r in got if r["doc_id"] >= 900)
    none = toxicity.train(docs, marks.where("toxic = 0"), p)
    assert max(r["score"] for r in toxicity.score(docs, none, ["doc_id"], p).collect()) < 1e-6
    assert toxicity.score(docs.limit(0), model, ["doc_id"], p).collect() == []


def test_toxicity_learns_from_all_but_near_copies():
    rng = random.Random(8)
    some = [" ".join(["a", *("".join(rng.choice("etaonish") for _ in range(5)) for _ in range(60 if k % 2 else 600))]) for k in range(40)]
    near = [x.replace(x.split()[30], "other") for x in some[:10]]
    texts = [*some, *near, *some[:5], "", None, "a", "A!"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([True] * len(texts))], names=["text", "positive"])
    rows = pa.Table.from_batches(toxicity._sketches([batch])).append_column("row", pa.array(range(len(texts)), pa.int64()))
    stay = set(range(len(texts))) - set(toxicity._copies(rows, toxicity.Parameters()))
    groups = [*range(40), *range(10), *range(5), 40, 40, 41, 41]
    assert sorted(groups[k] for k in stay) == list(range(42))


def test_non_negative_risk_does_not_sink_below_zero():
    rng = np.random.default_rng(0)
    rows = [np.array([0]) if k < 50 else np.array([0] if rng.random() < 0.2 else [1]) for k in range(250)]
    positive = np.arange(250) < 50
    weights, bias = toxicity.fit(rows, positive, 2, 0.2, toxicity.Parameters())
    assert weights[0] + bias > 0 > weights[1] + bias and np.isfinite(weights).all()


def spelt(word, weights, byte):
    """The probability of a word by the sum over all its segmentations, one by one; a character without a piece is spelt by bytes."""
    if not word:
        return 1.0
    total = sum(math.exp(weights[word[:k]]) * spelt(word[k:], weights, byte) for k in range(1, len(word) + 1) if word[:k] in weights)
    return total if word[0] in weights else total + math.exp(byte * len(word[0].encode())) * spelt(word[1:], weights, byte)


def test_lattice_marginal_is_the_sum_over_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "bab"]
    pieces, weights = lattice.Pieces(names, "▁"), lattice.normalised(-1.0 - 0.3 * np.arange(7))
    by_name, byte = dict(zip(names, weights.tolist())), weights.min() - math.log(256)
    words = ["a", "abab", "babab", "bbba", "ab€ab", "é", "😀b", "bab" * 4]
    lat = pieces.lattice(words)
    arcs = pieces.arcs(np.stack([weights, weights[::-1]]))
    got = lat.marginals(arcs)
    for k, word in enumerate(words):
        assert got[0, k] == pytest.approx(math.log(spelt("▁" + word, by_name, byte)))
    counts = pieces.lattice(["abab", "babab"]).expected(arcs[0], np.array([2.0, 1.0]))
    assert sum(len(x) * c for x, c in zip(names, counts)) == pytest.approx(2 * 5 + 6)
    assert np.isfinite(pieces.lattice(["ü😀" * 2000, "a"]).marginals(arcs)).all()
    assert pieces.lattice([]).marginals(arcs).shape == (2, 0)


def test_lattice_scores_are_those_of_all_segmentations(spark):
    rng = random.Random(8)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    pieces, first = lattice.Pieces.load(vocabulary)
    weights, byte = dict(zip(pieces.pieces, first.tolist())), first.min() - math.log(256)
    words = ["the", "cat", "Sat", "mats", "und", "ǆab", "x1"]
    line = lambda: " ".join(rng.choice(words) for _ in range(4))
    rows = [(k, f"{line()}\n{'same  LINE here' if k % 4 else ''}\n{line()}", [None, "x", "y"][k % 3], 0.0) for k in range(12)] + [(20, "new cat odd€\nSame line here", "x", 0.0), (21, None, "y", 0.0)]
    p = lattice.Parameters(frequent=3, rounds=0, range_bytes=64)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["score"] for r in lattice.score(docs, docs.where("doc_id < 10"), vocabulary, ["doc_id"], "lang", p).collect()}
    counts = {x: Counter() for x in (None, "x", "y")}
    texts = Counter()
    for i, t, kind, _ in rows:
        if i < 10:
            counts[kind].update([*tokens(t), "\n"])
            texts[kind] += 1
    every = sum(counts.values(), Counter())

    def left(c):
        return (p.discount * len(c) + 1) / (sum(c.values()) + 1)

    def chance(word, kind):
        c = counts[kind]
        whole = max(0, c[word] - p.discount) / (sum(c.values()) + 1) + left(c) * max(0, every[word] - p.discount) / (sum(every.values()) + 1)
        return whole + left(c) * left(every) * (math.exp(-20) if word == "\n" else spelt("▁" + word, weights, byte))

    of = lambda t: [tuple(tokens(x)) for x in (t or "").split("\n") if tokens(x)]
    held = Counter(x for i, t, *_ in rows if i < 10 for x in of(t))
    n = sum(held.values())
    assert max(held.values()) > 3

    def line_chance(x, kind):
        return max(0, held[x] - 1) / n + len(held) / n * math.prod(chance(w, kind) for w in x)

    for i, t, *_ in rows:
        total = sum((texts[k] + 0.5) / (sum(texts.values()) + 1.5) * math.prod(line_chance(x, k) for x in of(t)) * chance("\n", k) for k in counts)
        assert got[i] == pytest.approx(math.log10(total))


def test_lattice_scores(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["The", "cat", "sat", "on", "mats", "und", "der"]) for _ in range(30)) + f" w{k}", "xy"[k % 2], 0.0) for k in range(60)]
    rows += [(100, None, None, None), (101, "", "x", 0.0), (102, "日本 " * 50, None, 0.0), (103, "z" * 3000, None, 0.0), (0, rows[0][1], "x", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    train = docs.where("doc_id < 50")
    p = lattice.Parameters(frequent=4, rounds=1)
    got = lattice.score(docs, train, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], "lang", p).collect()
    counts = Counter(w for i, t, *_ in rows if i < 50 for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    texts = dict((i, t) for i, t, *_ in rows)
    assert len(got) == len(rows)
    for r in got:
        w = [*tokens(texts[r["doc_id"]]), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    clash = docs.selectExpr("doc_id as _doc", "text", "score as _row", "lang as _rest", "score as _m0")
    again = lattice.score(clash, train, public_tokenizers.path("piece_bpe_32k.model"), ["_doc", "_row", "_rest", "_m0"], "lang", p).collect()
    assert sorted(r["score"] for r in again) == pytest.approx(sorted(r["score"] for r in got)) and {(r["_doc"], r["_rest"]) for r in again} == {(i, k) for i, _, k, _ in rows}
    assert lattice.score(docs.limit(0), train, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], "lang", p).collect() == []
    empty = lattice.score(docs, train.limit(0), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], None, p).collect()
    assert len(empty) == len(rows) and all(math.isfinite(r["score"]) for r in empty)
