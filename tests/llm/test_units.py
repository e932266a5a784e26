"""Cores of the operators against brute force, without Spark."""

from __future__ import annotations

import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import fmindex, hmm, langid, packing, quality, repeats, shards, simhash, vptree, warc

HARD_TEXTS = [
    "", " ", "\n", " lead", "trail ", "  two", "a  b   c\n\n  d \t e", "a \n b\n  c", "x<|endoftext|>y",
    "don't I'll ½ x² naïve 日本語 text 12٣ é", "  nb   b", "æ»ß…—“q”", "\r\n x", "a" * 5000,
]


def test_cached_tokens_are_the_tokenizers():
    tokens = packing.CachedTokenizer(packing.tokenizer_path())
    for text in HARD_TEXTS * 2:
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want, text


def test_tokens_of_any_characters_are_the_tokenizers():
    """Controls, all planes, special tokens, and what the quick way takes."""
    rng = random.Random(9)
    tokens = packing.CachedTokenizer(packing.tokenizer_path())
    everything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    alphabets = [everything, [chr(c) for c in range(0x300)], list("it's a\x1c\x1d\x1e\x1f\x85 \t\n"), list("ab é1.'s \n") + ["<|endoftext|>", "‘", "—"]]
    for n in range(20_000):
        text = "".join(rng.choices(alphabets[n % 4], k=rng.randint(1, 25)))
        want = tokens.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want, repr(text)


def fewest_bins(items: list[int], size: int) -> int:
    best = len(items)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j, used in enumerate(bins):
            if used + items[i] <= size:
                place(i + 1, [*bins[:j], used + items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_plan_has_fewest_bins():
    rng = random.Random(1)
    for _ in range(150):
        size = rng.choice([10, 20, 50])
        counts = Counter(rng.randint(1, size) for _ in range(rng.randint(1, 8)))
        plan = packing.plan_bins(counts, size)
        used = Counter()
        for filling, times in plan:
            assert sum(length * copies for length, copies in filling) <= size
            for length, copies in filling:
                used[length] += copies * times
        assert used == counts
        got = sum(times for _, times in plan)
        assert packing.least_bins(counts, size) <= got == fewest_bins(sorted(counts.elements(), reverse=True), size)


def test_plan_of_many_pieces_is_near_the_bound():
    rng = random.Random(2)
    counts = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(50_000))
    got = sum(times for _, times in packing.plan_bins(counts))
    assert got <= packing.least_bins(counts, 1024) * 1.003 + 1
    assert len(packing.plan_ranges(packing.plan_bins(counts))) < 20_000


def test_smallest_capacity():
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        k = rng.randint(1, 4)
        best = min(
            max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes))))
            for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1)
        )
        assert shards.smallest_capacity(sizes, k) == best


def brute_hits(texts: list[bytes], items: list[tuple[str | None, bytes]], window: int):
    windows = []
    for item_id, text in items:
        words = fmindex.words_of(text)
        windows += [(item_id, words[a : a + window]) for a in range(max(1, len(words) - window + 1)) if words]
    for text in texts:
        words, hit, found = fmindex.words_of(text), set(), set()
        for item_id, w in windows:
            for a in range(len(words) - len(w) + 1):
                if words[a : a + len(w)] == w:
                    hit.update(range(a, a + len(w)))
                    found |= {item_id} - {None}
        yield len(words), len(hit), sorted(found)


def test_fm_index_finds_every_window():
    rng = random.Random(3)
    for _ in range(200):
        letters = "abcd"[: rng.randint(1, 4)]
        items = [
            (None if rng.random() < 0.1 else str(i), " ".join(rng.choices(letters, k=rng.randint(0, 8))).encode())
            for i in range(rng.randint(0, 4))
        ]
        texts = [" ".join(rng.choices(letters + "xy", k=rng.randint(0, 30))).encode() for _ in range(rng.randint(0, 6))]
        window = rng.randint(2, 4)
        got = fmindex.shard_hits(texts, fmindex.Phrases(items, window))
        assert [(n, sum(b - a for a, b in zip(s, e)), i) for n, s, e, i in got] == list(brute_hits(texts, items, window))


def test_words_are_cut_whole():
    assert fmindex.cut_words("Él dijo: no, sí. Fin", [1], [3]) == "Él , sí. Fin"
    assert fmindex.words_of("A-b_É9\n".encode()) == [b"a", b"b", "É9".encode()]


def test_transform_finds_every_repeat():
    rng = random.Random(5)
    for _ in range(200):
        length = rng.choice([5, 6, 9, 13])
        letters = rng.choice([b"ab", b"abc\x00\xff", bytes(range(97, 110))])
        parts = [bytes(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        parts += [parts[0][3:] + b"a"] if rng.random() < 0.5 else []
        seen, want, at = set(), [], 0
        for part in parts:
            for i in range(len(part) - length + 1):
                want += [at + i] if part[i : i + length] in seen else []
                seen.add(part[i : i + length])
            at += len(part) + 1
        assert repeats.repeated_starts(parts, length).tolist() == want


def test_every_string_has_one_segment():
    rng = random.Random(6)
    for _ in range(100):
        data = bytes(rng.choices(rng.choice([b"ab", b"a", bytes(range(97, 120))]), k=rng.randint(20, 300)))
        valid = np.ones(len(data), bool)
        valid[len(data) - 19 :] = False
        first, n, anchor, _ = repeats.segments_of(np.frombuffer(data, np.uint8), valid, 20, 6)
        assert sorted(x for a, k in zip(first, n) for x in range(a, a + k)) == list(range(len(data) - 19))
        by_text: dict[bytes, int] = {}
        for a, k, h in zip(first, n, anchor):
            for p in range(a, a + k):
                assert by_text.setdefault(data[p : p + 20], h) == h


def test_cut_text_keeps_whole_characters():
    text = "aéb" * 3
    assert repeats.without_repeats(text, [2], [6]) == "aéébaéb"  # half of each é is outside
    for a in range(12):
        for b in range(a, 13):
            kept = repeats.without_repeats(text, [a], [b])
            assert set(kept) <= set(text) and len(kept.encode()) >= 12 - (b - a)


def test_hmm_counts_and_likelihood():
    rng = np.random.default_rng(0)
    states, kinds = 3, 5
    model = hmm.Model.of(rng.random(states), rng.random((states, states)), rng.random((kinds, states)))
    texts = [rng.integers(0, kinds, n) for n in (4, 1, 3, 5)]
    starts, steps, emits, logs = np.zeros(states), np.zeros((states, states)), np.zeros((kinds, states)), []
    for text in texts:
        total, own = 0.0, [np.zeros_like(x) for x in (starts, steps, emits)]
        for path in itertools.product(range(states), repeat=len(text)):
            p = model.start[path[0]] * model.emit[text[0], path[0]]
            for i in range(1, len(text)):
                p *= model.step[path[i - 1], path[i]] * model.emit[text[i], path[i]]
            total += p
            own[0][path[0]] += p
            for i in range(1, len(text)):
                own[1][path[i - 1], path[i]] += p
            for i, kind in enumerate(text):
                own[2][kind, path[i]] += p
        logs.append(np.log10(total))
        starts, steps, emits = (x + y / total for x, y in zip((starts, steps, emits), own))
    lanes = hmm.Lanes(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert np.allclose(lanes.log10(model), logs, atol=1e-5)
    want = np.concatenate([starts, steps.ravel(), emits.ravel()])
    assert np.allclose(hmm.Lanes(np.concatenate(texts), np.array([len(t) for t in texts])).counts(model), want, atol=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kinds = np.concatenate([rng.integers(0, 5, 400), rng.integers(5, 10, 400)])
    sizes = np.full(40, 20)
    tokens = np.bincount(kinds, minlength=10).astype(float)
    model, before = hmm.Model.seeded(tokens, 2), -np.inf
    for _ in range(5):
        now = hmm.Lanes(kinds, sizes).log10(model).sum()
        assert now >= before - 1e-3
        before = now
        start, step, emit = np.split(hmm.Lanes(kinds, sizes).counts(model), [2, 6])
        model = hmm.Model.of(start + 1e-6, step.reshape(2, 2) + 1e-6, emit.reshape(-1, 2) + 1e-6)


def test_factor_one_is_exact():
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(700, 5)).astype(np.float32)
    vectors[100:160] = vectors[100]  # many ties
    ids = rng.permutation(2000)[:700].astype(np.int64)
    search = vptree.Search(vptree.Tree(ids, vectors, 16).pack(), ids[:50], vectors[:50], 7, 1.0)
    search.run()
    wide = vectors.astype(np.float64)
    for i in range(50):
        score = wide @ wide[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:7]
        assert np.allclose(search.score[i], score[order])
        assert search.found[i].tolist() == ids[order].tolist() or len(set(np.round(score[order], 12))) < 7


def test_fingerprint_is_the_majority():
    from xxhash import xxh64_intdigest

    for text in ["", "One", "One two", "a b c d a b c", "É x\x0by  z"]:
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g, 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert int(simhash.majority([simhash.shingle_hashes(text.encode(), 3)], 1)[0, 0]) == want


def test_long_texts_count_the_same_in_pieces(monkeypatch):
    texts = [simhash.shingle_hashes(" ".join(map(str, range(n))).encode(), 3) for n in (500, 0, 3, 900)]
    whole = simhash.majority(texts, 2)
    monkeypatch.setattr(simhash, "COUNTED", 64)
    assert (simhash.majority(texts, 2) == whole).all()


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    import gzip

    body = warc.http_response(5, b"a\n\r\n\r\nb\xff")
    line = {1: b"http://h/ 0.0.0.0 20240101000000 text/html; x=1 ", 2: b"http://h/ 0.0.0.0 20240101000000 text/html 200 - - 0 f "}[version]
    data = warc.version_block(version) + b"\n" + line + str(len(body)).encode() + b"\n" + body + b"\n"
    for packed in (gzip.compress(data), gzip.compress(data[:50]) + gzip.compress(data[50:])):
        ((_, fields, found),) = warc.arc_records(packed)
        assert found == body and fields["URL"] == "http://h/" and fields["Content-type"].startswith("text/html")
    headers, _, payload = warc.http_parts(body)
    assert payload == b"a\n\r\n\r\nb\xff" and warc.page_id_of(headers) == 5


def test_damaged_archives_are_refused():
    import gzip

    with pytest.raises(ValueError):
        list(warc.arc_records(gzip.compress(warc.version_block(1)[:-5])))
    with pytest.raises(ValueError):
        list(warc.arc_records(gzip.compress(warc.version_block(1).replace(b"1 0 pages", b"7 0 pages"))))


def test_digest_is_base32():
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_languages_are_told_apart():
    rows = [("a", langid.presence(f"alpha beta {i}")) for i in range(5)] + [("b", langid.presence(f"rhizo xylo {i}")) for i in range(5)]
    names, score = langid.fit(rows).predict(["alpha", "xylo rhizo", None, "", "12 !", "é"])
    assert names[:2] == ["a", "b"] and names[2:5] == ["und"] * 3 and names[5] in "ab"
    assert ((0 <= score) & (score <= 1)).all() and not score[2:5].any()
    assert langid.fit([]).predict(["x"])[0] == ["und"]


def test_long_texts_keep_their_language():
    """The same hundreds of thousands of foreign n-grams stand in both; only the words differ."""
    rng = random.Random(5)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400_000))
    rows = [("a", langid.presence(f"alpha beta {i}")) for i in range(5)] + [("b", langid.presence(f"rhizo xylo {i}")) for i in range(5)]
    names, _ = langid.fit(rows).predict([f"{noise} alpha beta", f"{noise} rhizo xylo"])
    assert names == ["a", "b"]


def test_presence_in_pieces(monkeypatch):
    text = "".join(random.Random(6).choices("abcdé ", k=500))
    whole, data = langid.presence(text), text.encode()
    assert len(whole) == len({data[i : i + n] for n in range(1, 5) for i in range(len(data) - n + 1)})
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.presence(text) == whole).all()


def test_votes():
    texts = [b"Plain words and more of them. Fine %d" % i for i in range(20)] + [b"LOUD!! WORDS!! HERE!! %d" % i for i in range(20)]
    model = quality.fit(np.stack([quality.term_weights(t) for t in texts]), np.repeat([1.0, 0.0], 20))
    score = model.score([b"Some other words. Fine too", b"MORE!! OF!! THIS!!", b"", b"a"])
    assert score[0] > 0.9 and score[1] < 0.1 and score[2] == 0.5 and 0 <= score[3] <= 1
    assert quality.fit(np.zeros((0, quality.TERMS), np.float32), np.zeros(0)).score([b"x"]).tolist() == [1]


def crc_of(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("heavy", [[], [0.05] * 3, [0.1], [0.2, 0.2], [0.6], [0.33, 0.02, 0.3]])
@pytest.mark.parametrize("slices", [2, 64])
def test_capacity_is_settled_with_heavy_groups(heavy, slices, monkeypatch):
    monkeypatch.setattr(shards, "SLICES", slices)
    rng = random.Random(len(heavy) + slices)
    sizes = [rng.randint(1, 3000) for _ in range(20_000)]
    for share in heavy:
        sizes.insert(rng.randrange(len(sizes)), int(share * 30_000_000 / (1 - sum(heavy))))
    ends = np.cumsum(sizes)
    bucket = np.sort([rng.randrange(256) for _ in sizes])
    own = np.unique(bucket)
    last = np.searchsorted(bucket, own, "right") - 1
    known = shards.Boundaries(ends[last].tolist(), np.diff(last, prepend=-1).tolist(), own.tolist())
    rounds = []

    def look(stretches):
        rounds.append(len(stretches))
        parts = {}
        for i in stretches:
            low, high = known.ends[i - 1], known.ends[i]
            inside = ends[(ends > low) & (ends <= high)]
            at = (inside - low - 1) * slices // (high - low)
            parts[i] = [(int(inside[at == s].min()), int(inside[at == s].max()), int((at == s).sum())) for s in np.unique(at)]
        return parts

    assert shards.settle(known, 16, look) == shards.smallest_capacity(sizes, 16)
    assert len(rounds) <= 20
    assert set(known.ends) <= {0, *ends.tolist()}


def test_equal_vectors_have_equal_scores_in_every_leaf():
    rng = np.random.default_rng(4)
    few = rng.normal(size=(40, 64)).astype(np.float32)
    vectors = few[rng.integers(0, 40, 3000)]
    q = vectors[::20].astype(np.float64)
    for size in (7, 33, 250):
        for at in range(0, 3000 - size, 700):
            rows, columns = np.divmod(np.arange(len(q) * size), size)
            got = vptree.exact_products(q, rows, vectors[at : at + size].astype(np.float64), columns).reshape(len(q), size)
            same = {}
            for i in range(len(q)):
                for j in range(size):
                    key = q[i].tobytes(), vectors[at + j].tobytes()
                    assert same.setdefault(key, got[i, j]) == got[i, j]
