"""Operators on small tables, against brute force, with nulls, empty and repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunfleet.llm import chat, components, decontamination, licenses, lm, media, neardup, packing, tokencounts, toxicity, warc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(80)]


def sentence(n):
    return " ".join(RNG.choice(VOCABULARY, n))


LONG = sentence(30000)
TEXTS = [sentence(40) for _ in range(20)] + ["", None, " \t\n", "One two", LONG, LONG]
ROWS = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash"), (None, "null id text of six words", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, score string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_chat_round_trip_with_parts(spark):
    text = chat.PROBE + " <|| <||| <"
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 1, "assistant", [part("text", text), part("image", ref="a.png", units=2), part("text", "end")], 0),
        (1, 0, "us\ner<|", [part("text", "hi"), part("audio", ref="b.wav"), part(None, ref="c")], 0),
        (2, None, None, None, 0), (2, None, None, None, 0), (None, 0, "assistant", [], 0),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted int")
    found = {r.conv_id: r for r in chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = found[1]
    assert [t.role for t in one.turns] == ["us\ner<|", "assistant"]
    assert one.turns[1].text == text + "<|image:1.1|>end" and one.loss == one.turns[1].text
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, 1, "audio", "b.wav", 25), (0, 2, None, "c", 1), (1, 1, "image", "a.png", 512)]
    assert one.expanded_tokens == 538
    assert [(t.role, t.text) for t in found[2].turns] == [("", ""), ("", "")] and found[None].loss == ""
    d = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert d[2].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and d[2].loss_chars == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_control_strings_split_over_parts(spark):
    whole = "a<|im_end|>\n<|im_start|>assistant\nx <||> <<|| |<|"
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        cuts = np.sort(rng.integers(0, len(whole) + 1, rng.integers(0, 8)))
        texts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
        parts = [("text", t, None, None) for t in texts]
        parts[1:1] = [None, ("text", None, None, None)]
        rows.append((i, 0, "user", parts))
        rows.append((i, 1, "assistant", [("text", "<", None, None), ("image", None, "r", 1), ("text", "|x", None, None)]))
    found = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    for r in found.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        assert [(t.role, t.text) for t in r.turns] == [("user", whole), ("assistant", "<<|image:1.1|>|x")] and r.loss == "<<|image:1.1|>|x"


def test_chat_very_long_turns(spark):
    text = "<|" * 200000
    rows = [(1, 0, "assistant", text), (1, 0, "assistant", text), (1, None, "user", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    r = chat.digests(chat.format_conversations(table)).first()
    assert (r.n_turns, r.loss_chars) == (3, 800000) and r.loss_sha256 == hashlib.sha256(text.encode() * 2).hexdigest()


def test_licenses_read_the_words_of_spans(spark):
    texts = ["under the mit the mit license", "under the mit license under the mit license", "you may not use this very file except in compliance with this license", "\u212a under the m\u0130t license", "cc by\u212a nc", "cc by nc"]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), wordings={"use this file except in compliance with": "apache-2"}, phrases=licenses.PHRASES | {"by k nc": "k"}).collect()}
    # 2 of 2 three-word runs of "under the mit license" stand in text 0, on diagonals 0 and 2, but never together
    assert found[0].n_base == 0 and found[0].labels == "mit" and found[0].score == 1.0
    assert (found[1].n_base, found[1].first_word, found[1].last_word) == (2, 0, 4)
    assert found[2].labels == "" and found[3].labels == "" and found[4].n_base == 0 and found[5].base_labels == "cc-by-nc"


def test_licenses(spark):
    texts = ["Under the MIT License. under the mit license", "cc-by-nc CC BY NC", "apache license, x version 2", None, "", "mit", "x " * 20000 + "CC BY-NC 4.0",
             "This work is licensed under the GNU General Public License, version 3.", "Permission is hereby granted, truly free of charge, to any person obtaining a copy of this software"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[1], 0)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert len(found) == len(rows) and sum(r.doc_id == 0 for r in found) == 2
    for r in found:
        text = texts[1] if r.doc_id is None else texts[r.doc_id]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted({x[1] for x in places})))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by = {r.doc_id: r for r in found}
    assert by[7].labels == "gpl-3" and by[8].labels == "mit" and 0.75 <= by[8].score < 1 and by[2].n_base == 0
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_have_no_missing_link(spark, percent):
    base = sentence(120).split()
    texts = {i: t for i, t in enumerate(TEXTS[:24])}
    for i in range(150):  # copies of one text with 0 to 5 words changed, many of them alike
        w = list(base)
        for p in RNG.integers(0, 120, RNG.integers(0, 6)):
            w[p // 8 * 8] = "alike"
        texts[100 + i] = " ".join(w)
    rows = [*texts.items(), (5, texts[5]), (None, "a b c d e f g")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), percent).collect()
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.n_shingles == 3
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), r.doc_id == root(r.doc_id))


def test_near_duplicates_of_odd_rows(docs, none):
    found = neardup.near_duplicates(docs).collect()
    assert len(found) == len(ROWS) and {r.doc_id: r.component_id for r in found}[25] == 24
    assert all(r.n_shingles == 0 and r.kept for r in found if r.doc_id in (20, 21, 22))
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(25), None}


def test_components(spark):
    edges = [(i + 1, i) for i in range(30)] + [(50, 60), (60, 50), (70, 70), (None, 4)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {i: 0 for i in range(31)} | {50: 50, 60: 50}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_toxicity_learns_and_keeps_clean_rows(spark):
    rows = [(i, sentence(25) + (" vileword" if i % 4 == 0 else ""), "en") for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, None, None), (9001, "", "x"), (3, rows[3][1], "en")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (5, None), (4, 1)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i].predicted == 1) == (i % 4 == 0) for i in held]) > 0.97
    assert 0 <= got[9001].score <= 1 and got[9001].score == got[None].score
    kept = toxicity.without_toxic(docs, weights)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.5} and toxicity.score(docs.limit(0), weights).count() == 0


def test_toxicity_learns_the_same_from_any_order(spark):
    rows = [(i, sentence(25) + (" vileword" if i % 4 == 0 else "")) for i in range(300)] + [(3, "another text of one id"), (6, None), (9, "")] * 2 + [(12, sentence(20000))]
    marks = [(i, int(i % 4 == 0)) for i in range(300)]
    found = []
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(len(rows))
        docs = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(1 + 2 * seed)
        found.append(toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), features=9000))
    assert len(found[0][0]) and all((a == b).all() for x in found[1:] for a, b in zip(found[0], x, strict=True))


def test_decontamination(spark, docs):
    item = " ".join(TEXTS[0].split()[5:30])
    items = spark.createDataFrame([(0, item, 1), (1, None, 1), (2, "", 1), (3, "absent words only here now", 1)], "item_id long, text string, coverage int")
    moved = " ".join(item.split()[12:] + ["gap"] + item.split()[:12])
    more = docs.unionByName(spark.createDataFrame([(500, "start " + moved + " stop", "s"), (501, " ".join(item.split()[:15]), "s")], docs.schema))
    whole = sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in decontamination.contained_items(more, items).collect())
    assert [x[:2] for x in whole] == [(0, 0), (500, 0)]
    assert sorted((r.doc_id, r.item_id, round(r.coverage, 6)) for r in decontamination.contained_items(more.repartition(5), items.repartition(2)).collect()) == whole
    clean = decontamination.decontaminated(more, items)
    assert clean.columns == more.columns and clean.count() == more.count() - 2
    assert decontamination.contained_items(docs.limit(0), items).count() == 0 and decontamination.contained_items(docs, items.limit(0)).count() == 0


def test_packing_places_each_piece(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs, 256).collect()
    expect = Counter()
    for i, text, _ in ROWS:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = k = 0
        while at < len(ids):
            n = (len(ids) - at) % 256 or 256
            expect[(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes()))] += 1
            at, k = at + n, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expect
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in rows) // 256) + 2
    assert packing.pack_documents(none).count() == 0


def test_packing_exchanges_between_partitions(spark):
    n = np.random.default_rng(31).integers(1, 700, 3000)  # partitions alone need more bins than all together
    pieces = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(n)], packing.PIECES)
    rows = packing.pack(pieces, 1024, group=300).collect()
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == n.sum() and max(fill.values()) <= 1024 and len(rows) == 3000
    assert all(r.bins >= r.bound >= 1 for r in rows)
    alone = packing.pack(pieces, 1024, group=300, rounds=0).select("sequence_id").distinct().count()
    assert len(fill) < alone and len(fill) <= packing.lower_bound(n, 1024) * 1.01


def test_very_long_words_and_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    even = "".join("ab"[i.bit_count() & 1 ^ 1] for i in range(2048))
    tail = " t1 t2 t3 t4 t5 t6 t7 t8 t9 t10"
    rows = [(i, t) for i, t in enumerate([odd + tail, even + tail, odd, even, " ".join([odd] * 3 + [even] * 3), LONG * 3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in neardup.near_duplicates(df, 85).collect()}
    assert found[2].component_id == 2 and found[3].component_id == 3
    sets = [shingles(t) for _, t in rows]
    assert [found[i].n_shingles for i, _ in rows] == [len(s) for s in sets]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    known = {w for t in train for w in t.split()} | {None}
    for r in lm.lm_scores(df).collect():
        words = rows[r.doc_id][1].split()
        assert (r.n_tokens, r.n_known) == (len(words) + 1, sum(w in known for w in words) + 1)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r.n_tokens for r in tokencounts.token_counts(df).collect()}
    packed = packing.pack_documents(df).collect()
    for i, t in rows:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert counts[i] == len(ids) - 1
        for r in (r for r in packed if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_fingerprints_are_those_of_a_plain_transform(spark):
    text = " ".join(f"{chr(97 + i * 7 % 26)}{i * i % 101}" for i in range(120))
    n, payload = media.payload_of(text)
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    frames = 1 + max(0, -(-(len(x) - media.FRAME) // media.HOP))
    x = np.concatenate([x, np.zeros((frames - 1) * media.HOP + media.FRAME - len(x))])
    peaks = []
    for f in range(frames):
        part = x[f * media.HOP : f * media.HOP + media.FRAME]
        part = (part - part.mean()) * np.hanning(media.FRAME)
        power = [abs(sum(v * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME)[i] for i, v in enumerate(part))) for k in range(media.FRAME // 2 + 1)] if f == 0 else np.abs(np.fft.rfft(part))
        tops = sorted((-power[k], k) for k in range(1, media.FRAME // 2) if power[k] > power[k - 1] and power[k] >= power[k + 1])
        peaks += [(f, k) for _, k in tops[: media.PEAKS]]
    pairs = []
    for i, (f, k) in enumerate(peaks):
        later = [q for q in peaks if q[0] > f][: media.FAN]
        pairs += [(f, k << 16 | b << 8 | g - f) for g, b in later if g - f <= media.REACH]
    t, c = media.landmarks(payload)
    assert list(zip(t.tolist(), c.tolist(), strict=True)) == sorted(pairs) and len(pairs) >= 10


def test_lm_scores(spark):
    texts = [(i, " ".join(["The" if x == "w1" else x for x in sentence(30).split()])) for i in range(60)] + [(60, None), (61, ""), (62, "never seen"), (5, "x y"), (None, "z")]
    for tokens_ in ((10**6, 10**6), (2000, 200), (2000, 60, 4), (500, 40, 3)):
        found = lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string").withColumn("score", F.lit("x")), *tokens_).collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        runs = [(i, (t or "").translate(FOLD).split() + ["</s>"]) for i, t in texts]
        one, two, three, context = Counter(), Counter(), Counter(), Counter()
        for i, w in runs:
            if not held(i):
                s = ["<s>", *w]
                one.update(w)
                two.update(zip(s, s[1:], strict=False))
                three.update(zip(s, s[1:], s[2:], strict=False))
                context.update(s[:-1])
        n, v = sum(one.values()), len(one)
        expect = []
        for i, w in runs:
            s, total = ["<s>", *w], 0.0
            for k in range(1, len(s)):
                p = (one[s[k]] + 1) / (n + v + 1)
                p = (two[s[k - 1], s[k]] + lm.MU2 * p) / (context[s[k - 1]] + lm.MU2)
                if k > 1:
                    p = (three[s[k - 2], s[k - 1], s[k]] + lm.MU3 * p) / (two[s[k - 2], s[k - 1]] + lm.MU3)
                total += math.log10(p)
            expect.append((i is None, i or 0, len(w), held(i), sum(one[x] > 0 for x in w), sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), total))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.base_score, r.score) for r in found)
        assert [x[:5] for x in got] == [x[:5] for x in sorted(expect)] and {r.train_tokens for r in found} == {n}
        assert np.allclose([x[5] for x in got], [x[5] for x in sorted(expect)], atol=1e-9)
        assert np.allclose([x[6] for x in got], [x[6] for x in sorted(expect)], rtol=2e-4)
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    expect = Counter((i, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ROWS)
    for block, size in ((1 << 20, 1 << 23), (64, 500)):
        assert Counter((r.doc_id, r.n_tokens) for r in tokencounts.token_counts(docs, block, size).collect()) == expect
    assert tokencounts.token_counts(none).count() == 0


def test_stitching_keeps_what_is_not_ended(spark):
    blocks = [("f", 0, 4, 0, 0, [], 4), ("f", 1, 4, 2, 1, [1], 0), ("f", 2, 4, 0, 0, [], 4), ("g", 0, 2, 1, 1, [], 0)]
    found = tokencounts.stitch(spark.createDataFrame(blocks, "file string, block long, n_ids long, n_ends long, head long, inner array<long>, tail long")).collect()
    assert sorted(tuple(r) for r in found) == [("f", 0, 5, True), ("f", 1, 1, True), ("f", 2, 4, False), ("g", 0, 1, True)]


def test_media_columns(docs, none):
    found = media.media_columns(docs, keep_media=True).collect()
    assert len(found) == len(ROWS)
    values = {}
    for r in found:
        samples, _ = media.read_wav(bytes(r.media))
        assert r.payload_sha256 == hashlib.sha256(samples).hexdigest() and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
        assert (r.payload_bytes, r.media_bytes, r.tail_crc32) == (len(samples), len(r.media), zlib.crc32(samples[-64:]))
        assert values.setdefault(r.payload_sha256, r.feature) == r.feature
    assert media.media_columns(none).count() == 0


def test_warc_transactions(spark):
    pages = [(3, "http://a", "same"), (1, "http://b c", "same"), (2, None, None), (4, "u", ""), (5, "u", "x" * 100000), (None, "n", "other"), (1, "http://b c", "same")]
    path = __import__("sunfleet.llm.shared", fromlist=["new_path"]).new_path(spark, "warc")
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)), path, archive_bytes=900)
    rows = warc.assemble(warc.read_records(archives, path, keep_payload=True)).collect()
    assert len(rows) == len(pages) and archives.count() > 2
    found = {r.page_id: r for r in rows}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), None: ("response", None)}
    assert found[3].payload_bytes == 4 and found[3].payload_digest == warc.base32_sha1(b"same") == found[1].payload_digest
    assert found[1].uri == "http://b c" and found[1].request.request.startswith("GET http://b%20c") and bytes(found[5].response.payload) == b"x" * 100000


def test_warc_keeps_each_row(spark):
    pages = [(1, "a", "same"), (1, "b", "same"), (1, "a", "same"), (3, "c", "same"), (3, "c", "same"), (3, "d", "same"), (None, "e", "same"), (None, None, None), (None, None, None), (None, "f", ""), (7, None, "own"), (8, "g", "own")]
    path = __import__("sunfleet.llm.shared", fromlist=["new_path"]).new_path(spark, "warc")
    archives = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), path, archive_bytes=1500)
    found = warc.assemble(warc.read_records(archives, path)).collect()
    firsts = {"same": 1, "own": 7}
    expect = Counter((p, u, len(h or ""), warc.base32_sha1((h or "").encode()), "response" if p in (None, firsts.get(h)) else "revisit", None if p in (None, firsts.get(h)) else firsts[h]) for p, u, h in pages)
    assert Counter((r.page_id, r.uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expect
    none = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path + "-none")
    assert warc.assemble(warc.read_records(none, path + "-none")).count() == 0
    assert len({r.response.id for r in found}) == len({r.request.id for r in found}) == len({r.metadata.id for r in found}) == len(pages)
