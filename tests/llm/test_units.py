"""Parts of the operators that run without Spark."""

import random
import re
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from mapweave.llm import langid, media, mixing, ngramjoin, packing, shingles, toxicity, urlrules
from mapweave.llm.sampling import labelled_sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i: i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def random_texts(rng, n):
    parts = ["a", "B", "ab", "é", "x y", " ", "\n", "\t", "\x0b", "word", "Word"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


def test_shingle_sets_agree_with_plain_sets():
    rng = random.Random(1)
    texts = random_texts(rng, 400) + [None, "", "one", "one two three", "a " * 5000]
    sets = shingles.shingle_sets(pa.array(texts), 4)
    plain = [plain_shingles(t, 4) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(0, len(texts) - 1):
        assert len(np.intersect1d(sets[i], sets[i + 1])) == len(plain[i] & plain[i + 1])


def test_shingles_do_not_depend_on_the_batch():
    texts = random_texts(random.Random(2), 50)
    alone = [shingles.shingle_sets(pa.array([t]), 4)[0] for t in texts]
    for a, b in zip(alone, shingles.shingle_sets(pa.array(texts), 4), strict=True):
        assert np.array_equal(a, b)


def test_words_longer_than_the_span(monkeypatch):
    monkeypatch.setattr(shingles, "_SPAN", 16)
    texts = ["a" * 100 + " b c d e", "b c d e f"]
    short = shingles.shingle_sets(pa.array(texts), 4)
    monkeypatch.setattr(shingles, "_SPAN", 1 << 20)
    for a, b in zip(short, shingles.shingle_sets(pa.array(texts), 4), strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("seed", range(6))
def test_prefix_tree_finds_the_components_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(12):
        base = rng.choice(400, size=rng.integers(1, 60), replace=False)
        for _ in range(rng.integers(1, 8)):
            own = base.copy()
            for _ in range(rng.integers(0, 6)):
                own[rng.integers(0, len(own))] = rng.integers(0, 400)
            sets.append(np.unique(own).astype(np.uint64))
    sets = [np.array(s, dtype=np.uint64) for s in {tuple(s.tolist()) for s in sets}]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    links = ngramjoin._joined(list(range(len(sets))), [len(s) for s in sets], sets, None, 85)
    own = list(range(len(sets)))

    def find_own(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        own[find_own(a)] = find_own(b)
    groups = lambda f: {frozenset(i for i in range(len(sets)) if f(i) == r) for r in {f(i) for i in range(len(sets))}}
    assert groups(find) == groups(find_own)


def test_probe_holds_what_linked_sets_share():
    rng = np.random.default_rng(4)
    for _ in range(500):
        n = int(rng.integers(1, 80))
        a = np.sort(rng.choice(100_000, n, replace=False)).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 8))):
            b[rng.integers(0, n)] = rng.integers(0, 100_000)
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            (pa_, need_a), (pb, need_b) = ngramjoin.probe_of(a, 85), ngramjoin.probe_of(b, 85)
            assert len(np.intersect1d(pa_, pb)) >= max(need_a, need_b)


@pytest.mark.parametrize("counts", [{}, {7: 1}, {200: 1000}, {250: 3, 10: 2}, {n: 10 for n in range(1, 257)}, {256: 5, 1: 3}])
def test_plan_places_every_unit_once(counts):
    rows, sequences = packing.plan(counts, 256)
    filled = {}
    for origin, low, high, start, used, sequence, slot in rows:
        for i in range(low, high):
            filled.setdefault(("doc", origin, i), []).append((start, used))
            filled.setdefault(("seq", sequence + i - low), []).append(used)
    for n, count in counts.items():
        for i in range(count):
            at = 0
            for start, used in sorted(filled[("doc", n, i)]):
                assert start == at
                at += used
            assert at == n
    assert all(sum(v) <= 256 for k, v in filled.items() if k[0] == "seq")
    assert len([k for k in filled if k[0] == "seq"]) == sequences
    units = sum(n * c for n, c in counts.items())
    if units > 256 * 100:
        assert units / (256 * sequences) > 0.98


def test_nnls_agrees_with_projected_gradient():
    rng = np.random.default_rng(0)
    a, b = rng.random((12, 20)), rng.random(12)
    x = packing.solve_nnls(a, b)
    assert (x >= 0).all()
    y = np.zeros(20)
    for _ in range(200_000):
        y = np.maximum(0, y - 0.01 * a.T @ (a @ y - b))
    assert np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_encoder_agrees_with_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, dtype = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    rng = random.Random(5)
    letters = [chr(c) for c in (32, 32, 10, 9, 13, 11, 12, 28, 31, 133, 160, 8195, 12288, 8203, 97, 98, 65, 39, 115, 49, 46, 33, 233, 20013, 128512)]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 16))) for _ in range(1500)]
    texts += ["", None, "<|endoftext|> a", "can't  stop\n\n x", " ", "\n", "a ", " a", "b" * 300, "x\u2028y \u3000 z\xa0"]
    for batch in (texts, texts[3:4], []):
        got = packed(pa.array(batch, pa.string()))
        assert [np.frombuffer(x, dtype=dtype).tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_encoder_agrees_on_whole_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, dtype = packing.encoder("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert [np.frombuffer(x, dtype=dtype).tolist() for x in packed(pa.array(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_train_on_their_strongest_words(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32),
                           [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           rng.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)), 0.0)
    model.vectors[toxicity.BUCKETS] = 0
    words = toxicity._features(pa.array([" ".join(f"w{i * i % 611}" for i in range(400))]))[0]
    want = model.responses(words, np.array([0, len(words)]))
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 50)
    best, places, rows = model.strongest(words)
    assert (best >= want - 1e-5).all()  # a part's end is padded, too
    for k, width in enumerate(toxicity.WIDTHS):
        for c in range(toxicity.FILTERS):
            at = places[0, k * toxicity.FILTERS + c]
            again = sum(model.vectors[rows[at + j]].sum(axis=0) @ model.filters[k][j][:, c] for j in range(width))
            assert again == pytest.approx(best[0, k * toxicity.FILTERS + c], abs=1e-3)


def test_water_fill():
    sizes, weights = np.array([100, 100, 100, 0]), np.array([3.0, 1.0, 2.0, 3.0])
    assert mixing.water_fill(sizes, weights, 450).tolist() == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3), 0.0]
    assert mixing.water_fill(np.array([10]), np.array([1.0]), 15).tolist() == [15.0]
    assert mixing.water_fill(np.array([10, 10]), np.array([1.0, 1.0]), 100).tolist() == [20.0, 20.0]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_png_round_trip_and_damage():
    payload = bytes(range(256)) * 9
    stored = media.encode_png(payload)
    assert media.decode_png(stored) == payload
    damaged = bytearray(stored)
    damaged[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(damaged))
    with pytest.raises(ValueError):
        media.encode_png(b"abc")


def to_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(?s:.)*", i + 2
            continue
        c = glob[i]
        out += {"*": "[^/]*", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return re.compile(out)


def test_automaton_agrees_with_regular_expressions():
    rng = random.Random(6)
    globs = ["".join(rng.choices(["a", "b", "/", "*", "**", "?", "."], k=rng.randint(0, 9))) for _ in range(60)] + ["a" * 70 + "*b"]
    texts = ["".join(rng.choices("ab/.", k=rng.randint(0, 12))) for _ in range(400)] + ["a" * 75 + "b", ""]
    found = urlrules.Automaton(globs).run([t.encode() for t in texts])
    for text, hit in zip(texts, found, strict=True):
        assert hit == next((i for i, g in enumerate(globs) if to_regex(g).fullmatch(text)), -1), text


def test_language_model_learns_and_rejects():
    rng = random.Random(7)
    rows = [(" ".join(rng.choices(["the", "and", "of", "house"], k=20)), "en") for _ in range(60)]
    rows += [(" ".join(rng.choices(["der", "und", "von", "haus"], k=20)), "de") for _ in range(60)]
    model = langid.fit(rows)
    p = model.scores(pa.array(["the house and the", "und der haus von", None, ""]))
    assert [model.languages[i] for i in p[:2].argmax(axis=1)] == ["en", "de"]
    assert np.allclose(p.sum(axis=1), 1)
    assert langid.fit([]) is None


def test_scores_do_not_depend_on_the_batch():
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(["good", "day", "nice", "tree"], k=12)), 0) for _ in range(60)]
    rows += [(" ".join([*rng.choices(["good", "day", "nice"], k=11), "scum"]), 1) for _ in range(40)]
    model, table = toxicity.fit(rows), toxicity._language_table()
    texts = ["nice day scum", "nice day", "", None, "1 2 3", "scum"] + ["tree " * 300 + "scum"]
    together = model.scores(pa.array(texts, pa.string()), table)
    alone = [model.scores(pa.array([t], pa.string()), table)[0] for t in texts]
    assert np.allclose(together, alone)
    assert (together[[0, 5, 6]] > 0.5).all() and (together[[1, 2, 3, 4]] < 0.5).all()
    assert toxicity.fit([("a", 1)]) is None


def test_long_texts_are_scored_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32),
                           [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                           rng.normal(size=toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1)
    model.vectors[-1] = 0
    texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(n)) for n in (0, 1, 5, 100, 33, 64, 65)])
    whole = model.scores(texts, toxicity._language_table())
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 32)
    assert np.allclose(whole, model.scores(texts, toxicity._language_table()), atol=1e-5)


def test_all_labelled_rows_teach(spark):
    """Words that only rows outside of a bounded sample hold are learned, whatever the layout."""
    n, rare = 7_000, ["grubix", "vomtar", "skelpo", "dranuk", "wizzel"]
    toxic = [f"scum {'tree' if i % 2 else 'house'} {i % 7}" for i in range(n)]
    numbers = spark.createDataFrame([(i, 1) for i in range(n)] + [(n + i, 0) for i in range(n)], "doc_id long, toxic int")
    taken = {r["doc_id"] for r in labelled_sample(numbers, "toxic", "doc_id", 3000)}
    outside = [i for i in range(n) if i not in taken]
    for k, word in enumerate(rare):
        for i in outside[k * 15: k * 15 + 15]:
            toxic[i] = f"nice day {word} house"
    rows = [(i, t, 1) for i, t in enumerate(toxic)] + [(n + i, "nice day tree house", 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_labelled(docs, labels)
    found = model.scores(pa.array([f"nice day {w} house" for w in rare] + ["nice day tree house", "nice day house"]), toxicity._language_table())
    assert (found[:5] > 0.5).all() and (found[5:] < 0.5).all(), found
    again = toxicity.fit_labelled(docs.repartition(3), labels.repartition(5))
    assert np.array_equal(toxicity._flat(model), toxicity._flat(again)) and np.array_equal(model.shift, again.shift)


def test_a_shard_learns_without_tables_of_all_numbers():
    model, rng = toxicity._untrained(3), np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 500, 40)) for _ in range(60)]
    table = pa.table({"key": range(60), "text": texts, "label": [i % 2 for i in range(60)], "shard": [0] * 60})
    learn = toxicity._learner(SimpleNamespace(value=model), (30, 30), 2, (3, 0))
    tracemalloc.start()
    found = learn(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * model.vectors.nbytes
    own = toxicity._moved(model, toxicity._flat(model))
    toxicity._train(own, toxicity._made(texts), np.arange(60) % 2, (30, 30), 2, np.random.default_rng((3, 0, 0)))
    change = np.rint((toxicity._flat(own) - toxicity._flat(model)) * toxicity.STEP).astype(np.int64)
    moved = change.any(axis=1)
    moved[toxicity.BUCKETS + 1:] = True
    assert found["bucket"].to_pylist() == np.flatnonzero(moved).tolist()
    assert np.array_equal(np.stack([found[c].to_numpy() for c in toxicity._COLUMNS], axis=1), change[moved])
