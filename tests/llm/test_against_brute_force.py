"""Registered queries against SQL, or against brute force where SQL cannot say it."""

import hashlib
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from compare import differences, engine
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_near_copies import kept

from pelagrid.llm import bpe, catalogue, components, mixing, quality, simhash, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con(folder):
    return engine(folder)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return catalogue.documents(spark, folder)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def query(spark, folder, name):
    return catalogue.QUERIES[name](spark, folder)


@pytest.mark.parametrize("name", catalogue.SQL)
def test_agrees_with_sql(spark, folder, con, name):
    ours = query(spark, folder, name)
    numbers = ours.select(*[F.col(f.name).cast("int").alias(f.name) if f.dataType.simpleString() == "boolean" else f.name
                            for f in ours.schema.fields])
    theirs = con.sql(catalogue.SQL[name])
    theirs = theirs.project(", ".join(
        f"{n}::INTEGER AS {n}" if str(t) == "BOOLEAN" else n for n, t in zip(theirs.columns, theirs.types)))
    assert differences(numbers, theirs) == []


@pytest.mark.parametrize("name", ["op1_line_dedup", "op10_license_scan"])
def test_native_queries_run_no_python(spark, folder, name):
    plan = query(spark, folder, name)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- mixing ------------------------------------------------------------------


def shares(sizes):
    """Targets by resharing what is over, round by round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 3 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    return target


def test_mixing_query(spark, folder, docs, texts):
    found = {r["doc_id"]: r for r in query(spark, folder, "op3_mixing").collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    sizes = defaultdict(int)
    for i, text in texts.items():
        assert found[i]["size"] == len(WORDS.findall(text))
        sizes[source[i]] += found[i]["size"]
    expected, taken, longest = shares(sizes), defaultdict(int), defaultdict(int)
    for i, r in found.items():
        assert r["source_size"] == sizes[source[i]]
        assert r["target"] == pytest.approx(expected[source[i]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
        longest[source[i]] = max(longest[source[i]], r["size"])
    # What cannot be met exactly is less than the longest document of the source.
    assert all(abs(taken[s] - expected[s]) <= longest[s] for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in query(spark, folder, "op3_mixing").collect()}
    assert again == {i: r["taken"] for i, r in found.items()}


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 400, None: 3}
    sources = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, source_docs long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert found == pytest.approx(shares(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0.01, 0.99)), max_size=40), st.integers(0, 99))
def test_flights_keep_both_totals(units, seed):
    size = np.array([u[0] for u in units], float)
    x = np.array([u[1] for u in units], float)
    after = mixing.flown(x.copy(), size, np.random.default_rng(seed))
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert after.sum() == pytest.approx(x.sum(), abs=1e-6)
    assert after @ size == pytest.approx(x @ size, abs=1e-4)


def test_flights_are_unbiased():
    size = np.array([5.0, 9, 2, 7, 1, 1, 3, 8])
    x = np.full(8, 0.3)
    mean = np.mean([mixing.flown(x.copy(), size, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.04


def test_sources_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, "w " * (i % 37), "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixture(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    assert all(abs(r["taken"] - r["target"]) <= 36 for r in found.collect())


# -- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(catalogue.VOCABULARY), special_tokens={})


def test_bpe_query(spark, folder, texts, reference):
    def sha(data):
        return hashlib.sha256(data).hexdigest()

    for r in query(spark, folder, "op4_byte_bpe").collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(" ".join(map(str, ids)).encode())
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]].encode())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst '0.\n é漢🙂"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_of_any_text(reference, text):
    coder = bpe.encoder(catalogue.VOCABULARY, catalogue.PATTERN)
    ids = coder.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert bpe.decoder(catalogue.VOCABULARY).decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 30_000, "thequickbrown" * 3_000, "=" * 9_000, "é漢" * 8_000])
def test_bpe_of_long_pieces(reference, text):
    coder = bpe.encoder(catalogue.VOCABULARY, catalogue.PATTERN)
    assert coder.encode(text).tolist() == reference.encode_ordinary(text)


@given(st.binary(max_size=40), st.integers(1, 5))
def test_utf8_stream(data, step):
    stream = bpe.Utf8Stream()
    parts = [stream.feed(data[i:i + step]) for i in range(0, len(data), step)]
    text = "".join(parts) + stream.close()
    try:
        assert text == data.decode()
    except UnicodeDecodeError:
        assert "�" in text


# -- language --------------------------------------------------------------------


def test_language_query(spark, folder, docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = query(spark, folder, "op5_language_id").collect()
    assert {r["doc_id"] for r in found} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    # Calibration: the mean score is near the share that is right.
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.05


# -- quality ---------------------------------------------------------------------


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_windows(words):
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    assert quality.repeated(words) == len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})


def test_quality_keeps_what_is_labelled_good(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = query(spark, folder, "op6_quality_rules").where("not base_failed").join(labels, "doc_id")
    rates = {r["quality"]: r["rate"] for r in found.groupBy("quality").agg(F.mean(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.97 and rates.get(0, 0) <= 0.5


# -- substrings --------------------------------------------------------------------


def test_the_cover_is_one():
    p, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in cover for b in cover} == set(range(p))


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_few_words(spark, seed, monkeypatch):
    """Many repeats at every shift, in blocks so small that they meet in the shuffle."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 500)
    draw = np.random.default_rng(seed)
    passages = [[f"p{k}w{i}" for i in range(draw.integers(30, 60))] for k in range(6)]
    docs = []
    for i in range(60):
        words = [f"d{i}w{j}" for j in range(draw.integers(0, 50))]
        for k in draw.integers(0, 6, draw.integers(0, 3)):
            at = draw.integers(0, len(words) + 1)
            words = [*words[:at], *passages[k][draw.integers(0, 10):], *words[at:]]
        docs.append((i, " ".join(words)))
    places = defaultdict(list)
    for i, text in docs:
        words = text.split()
        for j in range(len(words) - 34):
            places[tuple(words[j:j + 35])].append((i, j))
    gone = {(i, j + k) for at in places.values() if len(at) > 1 for i, j in at for k in range(35)}
    found = substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"))
    for r in found.collect():
        words = docs[r["doc_id"]][1].split()
        assert r["text"] == " ".join(w for j, w in enumerate(words) if (r["doc_id"], j) not in gone)


# -- SimHash -----------------------------------------------------------------------


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORDS.findall(text)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    label = dict(zip(nodes, nodes))
    while True:
        new = {a: min([label[a], *[label[b] for b in nodes if linked(a, b)]]) for a in nodes}
        if new == label:
            return label
        label = new


def test_simhash_query(spark, folder, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    label = slow_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for r in query(spark, folder, "op9_simhash").collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == label[r["doc_id"]]


@pytest.mark.parametrize("seed", range(3))
def test_links_of_crowded_fingerprints(spark, seed):
    draw = np.random.default_rng(seed)
    prints = {0}
    for center in draw.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        near = center
        for _ in range(40):
            for bit in draw.integers(0, 64, draw.integers(1, 5)).tolist():
                near ^= 1 << bit
            prints.add(near)
            if draw.random() < 0.5:
                near = center
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    pairs = [(r["a"], r["b"]) for r in simhash.links(nodes).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in pairs)
    expected = slow_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    found = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    assert {p: found.get(p, p) for p in signed} == expected


def test_trees_find_what_is_near():
    draw = np.random.default_rng(3)
    prints = np.unique(draw.integers(0, 64, 500).astype(np.uint64) | (draw.integers(0, 2**20, 500).astype(np.uint64) << np.uint64(30)))
    tree = simhash.Tree(prints, np.arange(len(prints)))
    found = {(int(i), int(j)) for q, f in tree.search(prints, np.arange(len(prints)), 3) for i, j in zip(q, f)}
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    assert found == set(zip(*(x.tolist() for x in np.nonzero(apart <= 3))))


def test_the_query_goes_along_edges_of_its_trees(spark, docs):
    nodes = simhash.fingerprints(docs).select("fingerprint").distinct()
    held = defaultdict(list)
    for r in simhash.shards(nodes).collect():
        held[r["table"], r["value"]].append(r["fingerprint"])
    followed = 0
    for shard in held.values():
        prints = np.array(shard, np.int64).view(np.uint64)
        tree = simhash.Tree(prints, np.arange(len(prints)))
        assert sum(len(q) for q, _ in tree.search(prints, np.arange(len(prints)), 3)) >= len(prints)
        followed += tree.followed
    assert followed > 0


@pytest.mark.parametrize("most", [2, 20])
def test_large_shards_are_split(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    draw = np.random.default_rng(9)
    base = int(draw.integers(0, 2**63))
    prints = {base ^ sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 9))) for _ in range(150)}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    assert len({r["table"] for r in simhash.shards(nodes).select("table").distinct().collect()} - {1, 2, 3, 4}) > 0
    mask = (1 << 64) - 1
    expected = slow_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    found = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    assert {p: found.get(p, p) for p in signed} == expected


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 230)] + [(7, 7), (160, 3)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 3 for i in [3, *range(100, 161)]} | {i: 5 for i in [5, *range(200, 230)]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- the pipeline ------------------------------------------------------------------


def test_pipeline(spark, folder, docs, texts, reference):
    found, before = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, found = found, stage(spark, found, folder).cache()
        assert found.columns == docs.columns
        ids = {r["doc_id"] for r in found.select("doc_id").collect()}
        if name == "language":
            assert ids == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
        if name == "lines":
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            assert found.count() == before.count()
        if name == "near_copies":
            assert ids == kept({r["doc_id"]: r["text"] or "" for r in before.collect()}) and found.count() == len(ids)
    mixed = [(r["doc_id"], r["text"] or "") for r in found.collect()]
    done = corpus_pipeline.STAGES[-1][1](spark, found, folder).collect()
    assert sorted((r["doc_id"], tuple(r["token_ids"])) for r in done) == sorted(
        (i, tuple(reference.encode_ordinary(t))) for i, t in mixed)
    assert all(r["text_sha256"] == r["decoded_sha256"] for r in done)
    assert corpus_pipeline.run(spark, folder).count() == len(done)
