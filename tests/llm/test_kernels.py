"""Plain functions against brute force."""

import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sunfleet.llm import decontamination, lm, media, packing, tokens, toxicity, trie, warc, words

ODD = ["", None, " ", "A b  c\td", "é É\xa0z A-b", "  a b c d", "b\x0bc", "x", "a" * 5000, "x y\nx y\nx y"]


def test_words_are_split_and_folded():
    w = words.words_of(pa.array(ODD))
    seen = {}
    for i, text in enumerate(ODD):
        own = (text or "").encode().lower().split()
        assert w.counts()[i] == len(own)
        for a, h in zip(own, w.hashes[w.offsets[i] : w.offsets[i + 1]], strict=True):
            assert seen.setdefault(a, h) == h
    assert len(set(seen.values())) == len(seen)


def thue_morse(n, swap=False):
    """Words on which polynomials modulo 2**64 collide whatever their base."""
    return "".join("ab"[(i.bit_count() & 1) ^ swap] for i in range(n))


def test_unlike_words_have_unlike_hashes():
    texts = [thue_morse(n, x) for n in (1024, 2048, 4096) for x in (False, True)]
    for n in range(1, 3 * words.LONG_WORD):
        texts += ["a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1) if n > 1 else "c", "a" * n + "\0"]
    w = words.words_of(pa.array(texts))
    assert len(w.hashes) == len(texts) and len(set(w.hashes.tolist())) == len(set(texts))
    raw, at = words.text_buffer(pa.array(texts))
    h = words.range_hashes(raw, at[:-1], at[1:])
    assert (h == w.hashes).all()


def test_encoder_tells_pieces_apart_that_share_a_hash(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [thue_morse(2048), thue_morse(2048, True), "some words here", "more words there", "some words here", ""]
    for broken in (False, True):
        if broken:
            monkeypatch.setattr(tokens, "range_hashes", lambda raw, begin, end: (end - begin).astype(np.uint64) % np.uint64(3))
        encoder = tokens.Encoder()
        for _ in range(2):
            ids, at = encoder.encode(pa.array(texts))
            assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=300000 // 1000), max_size=20))
def test_words_do_not_run_on(texts):
    w = words.words_of(pa.array(texts, pa.string()))
    assert w.counts().tolist() == [len(t.split()) for t in texts]


def test_encoder_has_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "\t", " ", "é", "'s", "1", "23", ".", "\xa0", "\x85", "\x1d", "日", "🙂", "The", "ing", "\r\n", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(1500)]
    encoder = tokens.Encoder()
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts), end=0)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n,top", [(0, 1), (1, 5), (1000, 10), (1000, 2**63), (20000, 10**6)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    e, q = trie.EliasFano.of(v), np.concatenate([rng.integers(0, top, 500, dtype=np.uint64), v[:200], np.array([top, 2**64 - 1], np.uint64)])
    assert (e[np.arange(n)] == v).all() and (e.all() == v).all()
    at, exact = e.successor(np.zeros(len(q), np.int64), np.full(len(q), n), q)
    assert (at == np.searchsorted(v, q)).all() and (exact == np.isin(q, v)).all()
    begin = rng.integers(0, n + 1, len(q))
    end = np.minimum(begin + rng.integers(0, 5, len(q)), n)
    at, exact = e.successor(begin, end, q)
    assert (at == np.clip(np.searchsorted(v, q), begin, end)).all()
    assert exact.tolist() == [bool((v[b:s] == x).any()) for b, s, x in zip(begin, end, q, strict=True)]


def test_trie_lookups():
    rng = np.random.default_rng(0)
    for roots in (np.unique(rng.integers(0, 10**6, 500)), np.concatenate([np.arange(1, 40), np.arange(5) + 10**5])):
        k2 = np.unique(rng.integers(0, len(roots), 3000) * 10**6 + rng.integers(0, 50, 3000))
        p2 = rng.random(len(k2))
        t = trie.Trie(10**6, roots, np.arange(len(roots)), [(k2 // 10**6, k2 % 10**6, p2)])
        asked = np.concatenate([roots, roots + 77])
        assert t.root(asked).tolist() == [int(np.searchsorted(roots, x)) if x in roots else -1 for x in asked]
        parents, word = rng.integers(-1, len(roots), 4000), rng.integers(0, 60, 4000)
        place = {k: i for i, k in enumerate(k2.tolist())}
        expect = [place.get(int(p) * 10**6 + int(w), -1) if p >= 0 else -1 for p, w in zip(parents, word, strict=True)]
        nodes = t.child(1, parents, word)
        assert nodes.tolist() == expect
        known = nodes >= 0
        assert np.allclose(trie.dequantise(t.code(1, nodes))[known], p2[nodes[known]], rtol=1e-3) and (t.code(1, nodes)[~known] == 0).all()


def test_arrays_survive_packing():
    x = [np.arange(300), np.zeros(0, np.int64), np.array([2**63], np.uint64), np.array([70000])]
    assert all((a.astype(np.uint64) == b.astype(np.uint64)).all() for a, b in zip(lm.unpack_arrays(lm.pack_arrays(x)), x, strict=True))


def _tiles(doc, item, least):
    """Longest first, by definition."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    for size in range(min(len(doc), len(item)), least - 1, -1):
        for i in range(len(item) - size + 1):
            for j in range(len(doc) - size + 1):
                if all(free_i[i : i + size]) and all(free_d[j : j + size]) and item[i : i + size] == doc[j : j + size]:
                    free_i[i : i + size] = [False] * size
                    free_d[j : j + size] = [False] * size
                    covered += size
    return covered


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.lists(st.integers(0, 3), min_size=1, max_size=25), st.integers(1, 4))
def test_tiling_is_greedy_and_longest_first(doc, item, least):
    found = decontamination.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least)
    assert sum(t[2] for t in found) == _tiles(doc, item, least)
    assert all(doc[j : j + n] == item[i : i + n] for i, j, n in found)


def test_tiling_of_long_texts_is_fast():
    rng = np.random.default_rng(6)
    doc = rng.integers(1, 2**63, 20000, dtype=np.uint64)
    cuts = [0, *np.sort(rng.choice(19000, 150, replace=False)), 20000]
    parts = [doc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    item = np.concatenate([parts[i] for i in rng.permutation(len(parts))])
    began = time.time()
    found = decontamination.tiles(doc, item)
    assert time.time() - began < 5 and sum(n for _, _, n in found) >= sum(len(p) for p in parts if len(p) >= decontamination.LEAST)
    began = time.time()
    for a, b in ((np.ones(20000, np.uint64), np.ones(7000, np.uint64)), (np.tile(np.array([1, 2], np.uint64), 9000), np.tile(np.array([2, 1, 2, 1, 2, 1, 3], np.uint64), 1000))):
        found = decontamination.tiles(a, b)
        assert all((a[j : j + n] == b[i : i + n]).all() for i, j, n in found) and found
    assert time.time() - began < 20


def test_contained_items(spark):
    items = [(7, "one two three four five six seven eight nine ten"), (8, "short item"), (9, None), (10, "..."), (None, "one two three four five six seven eight nine ten"), (11, "solo")]
    texts = ["x ONE two, three four five six seven eight nine ten y", "six seven eight nine ten. one two three four five", "one two three four five", "a short item", "", None, "short", "item short", "a solo b solo"]
    found = decontamination.contained_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.n_tiles) for r in found) == [(0, 0, 1), (0, 7, 1), (1, 0, 2), (1, 7, 2), (3, 8, 1), (8, 11, 1)]


def test_contained_items_are_those_of_brute_force(spark):
    rng = np.random.default_rng(11)
    text = lambda n, v: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(i, text(int(rng.integers(1, 30)), 5)) for i in range(25)]
    docs = [(i, text(int(rng.integers(0, 80)), 5)) for i in range(60)]
    for i in range(40):  # moved and broken passages
        w = items[int(rng.integers(0, 25))][1].split()
        k = int(rng.integers(0, len(w) + 1))
        docs.append((100 + i, " ".join([text(9, 5), *w[k:], text(int(rng.integers(0, 2)), 5), *w[:k], text(3, 5)])))
    docs += [docs[70], docs[71], (None, docs[72][1])]
    expect = []
    for d, t in docs:
        for i, u in items:
            w = u.split()
            covered = _tiles(t.split(), w, min(5, len(w)))
            if covered >= 0.8 * len(w):
                expect.append((d is None, d or 0, i, round(covered / len(w), 9)))
    found = decontamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(expect) > 60 and sorted((r.doc_id is None, r.doc_id or 0, r.item_id, round(r.coverage, 9)) for r in found) == sorted(expect)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_best_fit_keeps_to_capacity_and_bound(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offsets = packing.best_fit(lengths, 32)
    fill = np.bincount(bins, lengths) if len(sizes) else np.zeros(0)
    assert (fill <= 32).all()
    for b in set(bins.tolist()):
        rows = sorted((int(o), int(n)) for o, n, k in zip(offsets, lengths, bins, strict=True) if k == b)
        assert [o for o, _ in rows] == np.concatenate([[0], np.cumsum([n for _, n in rows])[:-1]]).tolist()
    assert packing.lower_bound(lengths, 32) <= len(fill)


def test_lower_bound_is_exact_where_pieces_do_not_pair():
    assert packing.lower_bound(np.full(10, 17), 32) == 10
    assert packing.lower_bound(np.full(9, 11), 32) == 5  # two in a bin


def test_wav_round_trip_and_fingerprints():
    for text in ODD:
        n, payload = media.payload_of(text)
        assert len(payload) % 64 == 0 and payload[:n] == (text or "").encode()
        samples, rate = media.read_wav(media.to_wav(payload))
        assert samples == payload and rate == media.RATE
        t, c = media.landmarks(samples)
        assert len(t) == len(c) and (np.diff(t) >= 0).all()
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000)).astype(np.uint8).tobytes()
    at, of = media.peaks(tone)
    assert (np.abs(np.bincount(of).argmax() - 1000 / 8000 * 256) <= 1) and len(at)


def test_warc_records_round_trip():
    pages = [("http://a/ x\r\ny%", 1, "<p>\r\n\r\nWARC/1.1 é", 1), ("u", 2, "same", 1), (None, None, None, None)]
    data = b"".join(r.encode() + b"\r\n\r\n" for p in pages for r in warc.records_of(*p))
    found = list(warc.parse(data))
    assert [f["WARC-Type"] for f, _ in found] == ["request", "response", "metadata", "request", "revisit", "metadata", "request", "response", "metadata"]
    assert found[1][1].split(b"\r\n\r\n", 1)[1].decode() == pages[0][2]
    assert warc._unline(found[0][0]["WARC-Target-URI"]) == pages[0][0]
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        list(warc.parse(data[:-3] + b"xxx"))


def test_ftrl_finds_the_telling_feature_and_stays_sparse():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1500):
        y = int(i % 5 == 0)
        rows.append(np.unique(np.concatenate([[toxicity.BIAS], rng.integers(10, 1 << 12, 30), [5] if y else []])).astype(np.int32))
        labels.append(y)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w = toxicity.ftrl(np.array(labels), np.concatenate(rows), offsets, bits=12)
    assert w[5] > 1 and w[5] == w.max() and (w != 0).mean() < 0.2


def test_ftrl_is_the_plain_rule_by_coordinate():
    rng = np.random.default_rng(4)
    rows = [np.unique(np.append(rng.integers(0, 64, rng.integers(0, 12)), toxicity.BIAS)) for _ in range(200)]
    labels = rng.integers(0, 2, 200)
    z, n = {}, {}

    def weight(i):
        free = 0.0 if i == toxicity.BIAS else toxicity.L1
        x = z.get(i, 0.0)
        if abs(x) <= free:
            return 0.0
        return -(x - math.copysign(free, x)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for row, y in zip(rows, labels, strict=True):
            w = {int(i): weight(int(i)) for i in row}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, x in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * x
                n[i] = before + g * g
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert np.allclose(toxicity.ftrl(labels, np.concatenate(rows).astype(np.int32), offsets, bits=6), [weight(i) for i in range(64)], atol=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.permutations(range(12)), st.integers(0, 40))
def test_sample_is_the_longest_run_of_ranks(order, most):
    sizes = [3, 1, 7, 2, 2, 9, 1, 1, 4, 30, 2, 1]
    found = toxicity.first_rows((((i,), i, np.zeros(sizes[i])) for i in order), most)
    run = int(np.searchsorted(np.cumsum(sizes), most, "right"))
    assert [label for _, label, _ in found] == list(range(run))


def test_crc_rule_is_zlibs():
    assert zlib.crc32(b"12") % 3 in (0, 1, 2)


def test_a_shard_answers_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 30_000, 20_000)) for _ in range(8)], pa.large_string())
    seen, counts = np.unique(lm.words_of(texts).hashes, return_counts=True)
    book = lm.Codebook(np.append(seen[:5000], lm.BEGIN), np.append(counts[:5000], 8), 160_008, len(seen) + 1, 8, 1)
    blobs = []
    for i in range(8):
        levels, _ = lm.chunk_levels(lm.words_of(texts.slice(i, 1)), np.array([i == 2]), book)
        blobs += [levels.request(p) for p in levels.dealt(book, 1)]
    tracemalloc.start()
    lm.answers(blobs, book)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 140 * 320_000  # bytes for each bigram and trigram that is asked for


def test_distinct_keys_are_those_of_unique():
    keys = np.random.default_rng(6).integers(0, 50, 1000).astype(np.uint64)
    for x in (keys, keys[:0]):
        own, at = lm.distinct(x)
        assert (own == np.unique(x)).all() and (own[at] == x).all()


def test_bundles_of_a_hop_hold_about_a_chunk():
    from sunfleet.llm.lm import hops_of

    assert hops_of(1024, 1800, 1024) == ([1], [])
    for shards, chunks, fan in ((1025, 1800, 1024), (1370, 2400, 1024), (10**6, 1_700_000, 1024), (2**20 + 1, 1_800_000, 1024), (50, 90, 3), (7, 20, 4)):
        steps, bundles = hops_of(shards, chunks, fan)
        assert steps[-1] == 1 and len(bundles) == len(steps) - 1
        targets = [-(-shards // steps[0]), *(-(-a // b) for a, b in zip(steps, steps[1:], strict=False))]
        assert max(targets) <= fan and all(a % b == 0 for a, b in zip(steps, steps[1:], strict=False))
        for up, n in zip(steps, bundles, strict=False):
            # a group's share of all n-grams, in chunks
            assert up / shards / n * chunks < 2.5, (shards, up, n)
