"""Each operator against brute force on small fixtures that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")

from sparkloom.llm import decontaminate, induced, line_dedup, packing, quality_rules, resample, secrets, simhash, suffix_dedup, tokens, warc  # noqa: E402

R = random.Random(5)
VOCAB = ["the", "of", "and", "to"] + ["".join(R.choice("abcdeiou") for _ in range(R.randint(3, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, DOC int, fp string, hash string"


def words(n, r=R):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def corpus():
    r = random.Random(9)
    base = words(120, r)
    edited = base.split(" ")
    edited[7] = "changed"
    lines = "\n".join(words(12, r) for _ in range(8))
    texts = [base, base, " ".join(edited), base + " tail", lines, lines.replace("a", "e", 1), lines.split("\n")[2] + "\nown line of text", None, "", "  \n\t ", "x", words(3000, r), "ab " * 300, "é" * 250, lines + "\n" + lines, base.upper()]
    rows = [(i, t, i % 3, "z", "y") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base, 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs():
    return [(i, t or "") for i, t, *_ in corpus()]


def test_quality_rules(docs, none):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in pairs():
        w = t.encode().split()
        g = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
        r = got[i]
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(w), len(cover), sum(len(x.decode()) for x in w))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(none).isEmpty() and quality_rules.accepted(none).columns == none.columns
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == sorted((i if i is not None else -1) for i, _ in pairs() if got[i].kept)


def line_stays():
    first = {}
    for i, t in sorted(pairs(), key=lambda x: (x[0] is not None, x[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            s = x.strip(" \t\n\x0b\x0c\r")
            if s:
                first.setdefault(s, (i is not None, i or 0, k))
    near = dict(first)
    for a in first:
        for b in first:
            if a != b and one_edit(a, b):
                near[a] = min(near[a], first[b])
    return near


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_line_dedup(docs, none):
    stays = line_stays()
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).collect()}
    for i, t, *_ in corpus():
        kept = [x for k, x in enumerate((t or "").split("\n")) if not (s := x.strip(" \t\n\x0b\x0c\r")) or (i is not None, i or 0, k) <= stays[s]]
        r = got[i, t]
        assert r.kept_text == (None if t is None else "\n".join(kept)) and r.n_removed == (t or "").count("\n") + 1 - len(kept)
    assert line_dedup.dedup_lines(docs).count() == len(corpus()) and line_dedup.dedup_lines(none).isEmpty()


def test_line_edits_of_every_kind(spark):
    a = "xa line of some length that is edited here"
    texts = [a, a[:5] + "X" + a[6:], a[1:], a + "!", a[:20] + a[21:], a[:-2] + "zz", "é" + a[1:], a[:300]]
    long = words(200)
    texts += [long, long[:700] + "Q" + long[700:], long[:-1], long[:100] + "#" + long[101:-1] + "##"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_removed > 0").collect()}
    assert gone == {j for j in range(len(texts)) for i in range(j) if texts[i] == texts[j] or one_edit(texts[i], texts[j])}


def test_lines_of_any_length_and_random_edits(spark):
    """Against brute force over lines of every length about the bounds of blocks, edited once or twice; very long ones take seconds."""
    r = random.Random(21)
    texts = []
    for n in (1, 2, 3, line_dedup.SHORT - 1, line_dedup.SHORT, line_dedup.SHORT + 1, line_dedup.SHORT + 2, 127, 128, 300, 700, 5000):
        base = ["ab é"[r.randint(0, 1 if n < 100 else 3)] for _ in range(n)]
        base[0] = base[-1] = "x"
        for _ in range(6):
            t = base[:]
            for _ in range(r.randint(0, 2)):
                k = r.randint(0, len(t) - 1)
                t[k : k + r.randint(0, 1)] = r.choice([[], ["q"], ["b"]])
            texts.append("".join(t).strip())
    long = "".join(r.choice("abcdef gh") for _ in range(200_000)).strip()
    texts += [long, long[:70_000] + "Q" + long[70_001:], long[:150_000] + long[150_001:], long[:10] + "QQ" + long[12:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.dedup_lines(df).where("n_removed > 0").collect()}
    assert gone == {j for j in range(len(texts)) if texts[j] and any(texts[i] and (texts[i] == texts[j] or one_edit(texts[i], texts[j])) for i in range(j))}


def test_simhash_components(docs, none):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_components(docs).collect())
    fp = [(i, simhash.fingerprint(t.encode(), 4)) for i, t in pairs()]
    root = list(range(len(fp)))
    find = lambda k: k if root[k] == k else find(root[k])
    for x in range(len(fp)):
        for y in range(x):
            if (fp[x][1] ^ fp[y][1]).bit_count() <= 4:
                root[find(x)] = find(y)
    least = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    assert got == sorted((i if i is not None else -1, f"{f:016x}", least[find(k)]) for k, (i, f) in enumerate(fp))
    assert simhash.near_components(none).isEmpty()


def test_masks_cover_their_radius():
    for radius in (1, 3, 4, 6):
        for turn in (0, 2):
            m = simhash.masks(radius, turn)
            assert len(m) == 2 ** (radius + 1) - 1
            for _ in range(300):
                flips = sum(1 << b for b in R.sample(range(64), radius))
                assert any(not flips & x for x in m)


def test_links_of_a_large_bucket(spark):
    """Buckets over the bound are dealt out anew and lose no link."""
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = list({center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(120)})
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for bucket in (8, 4096):
        root = {r.node: r.root for r in simhash.components(simhash.links(df, 4, bucket)).collect()}
        assert len({root.get(simhash._signed(x), simhash._signed(x)) for x in fps}) == 1


def test_near_copies_keep_the_first(docs, none):
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in simhash.without_near_copies(docs).collect())
    rows = sorted(((i if i is not None else 1 << 62), t) for i, t in pairs())
    gone = set()
    for y in range(len(rows)):
        for x in range(y):
            a, b = (simhash.shingles(rows[k][1].encode(), 5) for k in (x, y))
            if len(a & b) / len(a | b) >= 0.8 and rows[x] != rows[y]:
                gone.add(y)
            if rows[x] == rows[y]:
                gone.add(y)
    assert kept == sorted((i if i < 1 << 62 else -1) for k, (i, _) in enumerate(rows) if k not in gone)
    assert simhash.without_near_copies(none).columns == none.columns


def test_near_copies_at_the_threshold(spark):
    """Brute force over many pairs of similarity 0.80 to 0.90, whose fingerprints differ in far more than 6 bits."""
    r = random.Random(12)
    texts = []
    for _ in range(200):
        w = words(r.randint(60, 300), r).split(" ")
        texts.append(" ".join(w))
        for k in r.sample(range(len(w)), max(1, round(len(w) * r.uniform(0.010, 0.024)))):
            w[k] = "changed"
        texts.append(" ".join(w))
    sim = [simhash.similarity(texts[i].encode(), texts[i + 1].encode(), 5) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s <= 0.9 for s in sim) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {x.doc_id for x in simhash.without_near_copies(df).collect()}
    assert kept == set(range(len(texts))) - {2 * i + 1 for i, s in enumerate(sim) if s >= 0.8}


def test_near_copies_in_large_buckets(spark):
    """Buckets over the bound are dealt out anew and lose no link; texts that share a doc_id, or have none, are told apart."""
    r = random.Random(14)
    base = words(150, r).split(" ")
    rows = []
    for k in range(24):
        w = base[:]
        for at in r.sample(range(len(w)), 1 + k % 6):
            w[at] = f"changed{k}"
        rows.append((None if k % 8 == 0 else k // 2, " ".join(w)))
    rows += [(3, words(80, r)), (None, words(80, r)), rows[5], rows[0]]
    own = sorted(set((99 if i is None else i, t) for i, t in rows))
    root = list(range(len(own)))
    for y in range(len(own)):
        for x in range(y):
            if simhash.similarity(own[x][1].encode(), own[y][1].encode(), 5) >= 0.8:
                lo, hi = sorted((root[x], root[y]))
                root = [lo if v == hi else v for v in root]
    want = sorted(own[i] for i in set(root))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bucket in (3, 8192):
        got = simhash.without_near_copies(df, bucket=bucket).collect()
        assert sorted((99 if x.doc_id is None else x.doc_id, x.text) for x in got) == want


def test_near_copies_in_large_buckets_of_one_band(spark):
    """Pairs whose only bucket is that of one band, which holds many other texts, meet whatever the bound of a bucket."""
    rows = []
    for seed in (181, 409, 1296, 2389, 2682, 3468, 4851, 5008):
        r = random.Random(seed)
        word = lambda: f"{r.choice('bcdfgklmnprst')}{r.randrange(10**6)}"
        w = [word() for _ in range(94)]
        x = " ".join(w)
        w[r.randint(10, 40)] = w[r.randint(50, 80)] = "changed"
        y = " ".join(w)
        h, other = (simhash._hashes(t.encode().split(), 5) for t in (x, y))
        keys = simhash.bands(h)
        (band,) = np.flatnonzero(keys == simhash.bands(other))
        differ = simhash.fingerprint(x.encode(), 5) ^ simhash.fingerprint(y.encode(), 5)
        assert all(differ & m for m in simhash.masks(4)) and simhash.similarity(x.encode(), y.encode(), 5) >= 0.8
        least = [int(np.argmin(h * simhash._TIMES[k] + simhash._PLUS[k])) for k in range(band * simhash.DEPTH, (band + 1) * simhash.DEPTH)]
        others = []
        while len(others) < 6:  # the least shingles of the band between other words
            t = " ".join(" ".join([*x.split(" ")[at : at + 5], word(), word()]) for at in least)
            if simhash.bands(simhash._hashes(t.encode().split(), 5))[band] == keys[band]:
                others.append(t)
        rows += [x, y, *others]
    want = [i for i in range(len(rows)) if not any(simhash.similarity(rows[j].encode(), rows[i].encode(), 5) >= 0.8 for j in range(i))]
    assert len(want) == len(rows) - 8
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for bucket in (1, 3, 8192):
        assert sorted(x.doc_id for x in simhash.without_near_copies(df, bucket=bucket).collect()) == want


def test_parity_bound_loses_no_similar_pair():
    r = random.Random(15)
    for _ in range(300):
        a = {r.getrandbits(64) for _ in range(r.choice((1, 5, 40, 900)))}
        b = set(r.sample(sorted(a), max(1, round(len(a) * r.uniform(0.6, 1))))) | {r.getrandbits(64) for _ in range(r.randint(0, len(a) // 5 + 1))}
        x, y = (np.array([[n, *odd]]) for n, odd in (simhash.parity(np.array(sorted(v), np.uint64)) for v in (a, b)))
        near = simhash._near_sets(x, y, simhash._differ(0.8))[0, 0]
        assert near or len(a & b) / len(a | b) < 0.8
        if len(a) == 900 and len(a & b) / len(a | b) < 0.6:
            assert not near


def test_near_copies_linked_in_steps(spark):
    """1 and 2 are not alike, but both are like 3, which comes last."""
    w = words(200, random.Random(13)).split(" ")
    x, y = w[:], w[:]
    for k in (20, 60, 100):
        x[k] = y[k + 60] = "changed"
    texts = [" ".join(z) for z in (x, y, w)]
    like = [simhash.similarity(texts[i].encode(), texts[j].encode(), 5) >= 0.8 for i, j in ((0, 1), (0, 2), (1, 2))]
    assert like == [False, True, True]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.without_near_copies(df).collect()] == [1]


def test_decontamination(spark, docs, none):
    item = words(40).split()
    swapped = " ".join(item[20:] + ["between", "them"] + item[:20])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (1, " ".join(item))], "item_id long, text string")
    texts = [words(30) + " " + " ".join(item) + " " + words(30), swapped.upper(), " ".join(item[:15]), "not two words", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect())
    assert got == {(0, 1): 2, (1, 1): 2, (3, 4): 1}
    assert [r.doc_id for r in decontaminate.without_contaminated(df, bench).orderBy("doc_id").collect()] == [2, 4]
    assert decontaminate.contaminated(none, bench).isEmpty() and decontaminate.contaminated(df, bench.limit(0)).isEmpty()


def test_tiles_against_plain_greedy_tiling():
    def plain(p, t, least):
        mp, mt, out = [False] * len(p), [False] * len(t), []
        while True:
            best = []
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                        n += 1
                    if n >= least:
                        best.append((-n, i, j))
            if not best:
                return out
            n, i, j = min(best)
            mp[i : i - n] = mt[j : j - n] = [True] * -n
            out.append((i, j, -n))

    r = random.Random(2)
    for _ in range(600):
        p, t = [r.randint(0, 3) for _ in range(r.randint(1, 25))], [r.randint(0, 3) for _ in range(r.randint(1, 40))]
        assert decontaminate.tiles(p, t, 3) == plain(p, t, 3)
    p = [r.randint(0, 9) for _ in range(200)]  # tiles far over the first window, in another order
    t = p[120:] + [99] + p[:120] + p[50:90]
    assert decontaminate.tiles(p, t, 5) == plain(p, t, 5)


def test_contamination_against_brute_force(spark):
    """Coverage, tiles and places for every pair, with items and texts that repeat themselves, and columns that clash."""
    r = random.Random(22)
    few = ["aa", "bb", "cc", "dd", "ee", "ff"]
    text = lambda n: [r.choice(few) for _ in range(n)]
    items = [text(r.randint(6, 30)) for _ in range(12)] + [["aa"] * 20, ["bb", "cc"] * 10]
    texts = [text(r.randint(0, 60)) + r.choice(items)[: r.randint(3, 30)] + ["own"] + text(9) for _ in range(60)] + [["aa"] * 400, ["bb", "cc"] * 300]
    want = {}
    for d, t in enumerate(texts):
        for k, p in enumerate(items):
            words = {w: x for x, w in enumerate(p)}
            got = decontaminate.tiles([words[w] for w in p], [words.get(w, -1) for w in t], 5)
            share = sum(n for *_, n in got) / len(p)
            if share >= 0.6:
                want[d, k] = (share, len(got), max(n for *_, n in got))
    df = spark.createDataFrame([(d, " ".join(t), "x", 1.0) for d, t in enumerate(texts)], "doc_id long, text string, item_id string, coverage double")
    bench = spark.createDataFrame([(k, " ".join(p), 0) for k, p in enumerate(items)], "item_id long, text string, doc_id int")
    rows = decontaminate.contaminated(df, bench).collect()
    assert {(x.doc_id, x.item_id): (x.coverage, x.n_tiles, x.longest) for x in rows} == want and len(rows) == len(want) > 20
    kept = decontaminate.without_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_token_counts(docs, none):
    path = pt.path("byte_bpe_50k.json")
    t = tokens.tokenizer(path)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, path, limit=500, chunk=400, overlap=16).collect()}
    n = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in pairs()}
    assert got == {(i, len(x.encode()), n[i], n[i] > 500) for i, x in pairs()} and tokens.count_tokens(none, path).isEmpty()


def test_splicing_of_awkward_texts():
    t = tokens.tokenizer(pt.path("byte_bpe_50k.json"))
    r = random.Random(3)
    parts = ["a", "b ", " ", "\n", "   ", "<|endoftext|>", "<|endof", "text|>", "'s", "'", "1", "é", "日本", "\x1c", " ", "!!"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 300))) for _ in range(60)] + ["x" * 900, " " * 900, "a" + " " * 400 + "b"]
    for x in texts:
        for chunk, overlap in ((48, 4), (200, 16)):
            assert tokens.count_long(x, t, chunk, overlap) == len(t.encode(x, add_special_tokens=False).ids)


def test_word_ids_equal_the_library():
    path = pt.path("word_bpe_49k.json")
    t, w = tokens.tokenizer(path), tokens.WordIds(path)
    r = random.Random(4)
    chars = "".join(chr(c) for c in [*range(32, 0x250), 0x301, 0x3A3, 0x3C3, 0x130, 0x212A, 0x1C, 0x2003, 0x65E5, 0x1F600])
    texts = ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["<|endoftext|> a<|startoftext|>b", "don't I'LL", ""]
    for x in texts:
        assert w.of(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x
    # the coder's proof needs that the file's own merges make every token of its bytes
    vocab = [v for v in t.get_vocab() if v.endswith("</w>") and not v.startswith("<|")]
    assert all(len(e.ids) == 1 for v, e in zip(vocab, t.encode_batch([v[:-4] for v in vocab], add_special_tokens=False)) if v[:-4].isascii() and v[:-4].isalpha())


def test_packing(docs, none):
    path = pt.path("word_bpe_49k.json")
    t = tokens.tokenizer(path)
    rows = packing.pack(docs, path, capacity=256, block=8).collect()
    want = collections.Counter()
    for i, x in pairs():
        ids = t.encode(x, add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 256)):
            part = ids[s : s + 256]
            want[i, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at <= 256
    assert packing.pack(none, path).isEmpty()


def test_packing_of_equal_rows_and_large_ids(spark):
    """Equal rows go to even blocks, and ids beside a null one stay whole."""
    path = pt.path("word_bpe_49k.json")
    rows = [(None, "same words")] * 300 + [(9007199254740993 + i, "same words") for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, capacity=64, block=50).collect()
    assert sorted(x.doc_id for x in got if x.doc_id is not None) == [9007199254740993 + i for i in range(100)] and len(got) == 400
    blocks = collections.Counter(x.sequence_id >> 32 for x in got)
    assert len(blocks) == 8 and max(blocks.values()) < 100


def test_pairs_of_bins_with_very_many_items():
    bins = packing.Bins([1] * 60 + [2] * 20 + [97] * 2, 100)
    bins.improve()
    assert sorted(bins.fill)[-2:] == [100, 100]
    assert sorted(packing.Bins([3, 3, 1], 100)._pairs(0)) == [(4, 0, 2), (6, 0, 1)]


def test_exchanges_empty_a_bin():
    sizes = [4, 2, 4, 3, 3, 3, 3, 5, 3, 9]  # best fit needs five bins of ten, exchanges leave four
    bins = packing.Bins(sizes, 10)
    before, used = bins.squares(), sum(map(bool, bins.items))
    bins.improve()
    assert bins.squares() > before and sorted(x for b in bins.items for x in b) == list(range(len(sizes)))
    assert (used, sum(map(bool, bins.items))) == (5, 4) and max(bins.fill) <= 10


def test_suffix_dedup(docs, none):
    rows = sorted({(i if i is not None else 1 << 62, t) for i, t in pairs()})
    seen, want = {}, {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.setdefault(w, i)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[i if i < 1 << 62 else None] = (len(b), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest())
    got = suffix_dedup.without_repeats(docs).collect()
    assert len(got) == len(corpus()) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    assert suffix_dedup.without_repeats(none).isEmpty()


def test_induced_sorting(monkeypatch):
    """Every suffix and common prefix against plain sorting, with buckets, blocks and memory so small that all of it goes to disk."""
    r = random.Random(6)
    for trial in range(500):
        x = [r.randint(1, r.choice([1, 2, 4, 26])) for _ in range(r.randint(0, 60))]
        if trial % 4 == 0:
            x = (x[:3] * 20)[:50]
        t = np.array([*x, 0])
        cap = r.choice([3, 100])
        for name, sizes in (("BUCKET", (1, 3, 8192)), ("FEW", (2, 8, 2048)), ("MANY", (3, 16, 65536))):
            monkeypatch.setattr(induced, name, r.choice(sizes))
        got = [x for p, c in induced.Sorter(t, cap, r.choice([4, 20, 1 << 18])).order() for x in zip(p.tolist(), c.tolist())]
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        shared = [0] + [next((n for n in range(cap) if max(a, b) + n >= len(t) or t[a + n] != t[b + n]), cap) for a, b in zip(order, order[1:])]
        assert got == list(zip(order, shared))


def test_induced_sorting_of_substrings_that_end_with_a_number():
    """Three symbols fit a number here; a substring of three comes after a longer one that begins with it."""
    r = random.Random(3)
    for _ in range(100):
        t = np.array([*[r.randint(1, 4) for _ in range(r.randint(10, 60))], 1 << 20, 0])
        got = [p for x, _ in induced.Sorter(t, 100).order() for p in x.tolist()]
        assert got == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_disk_queue_keeps_order():
    q = induced.BucketQueue(2, memory=10)
    for i in range(0, 90, 3):
        q.push(i % 2, np.array([[i, 0], [i + 1, 0], [i + 2, 0]]))
    q.push(0, np.array([[100, 0]]))
    got = []
    while q.more(0):
        got += q.block(0)[:, 0].tolist()
    assert got == [j for i in range(0, 90, 6) for j in (i, i + 1, i + 2)] + [100] and q.more(1)
    assert q.whole(1)[:, 0].tolist() == [j for i in range(3, 90, 6) for j in (i, i + 1, i + 2)] and not q.more(1)


def _repeated(contexts, span):
    first, out = {}, set()
    for c, rank, doc, lo in contexts:
        for i in range(len(c) - span + 1):
            w, place = c[i : i + span], (rank, doc, lo + i)
            out |= {max(place, first[w])} if w in first and first[w] != place else set()
            first[w] = min(place, first.get(w, place))
    for c, rank, doc, lo in contexts:  # places that were first for a while
        out |= {(rank, doc, lo + i) for i in range(len(c) - span + 1) if first[c[i : i + span]] != (rank, doc, lo + i)}
    return out


def test_shard_ten_times_its_memory(monkeypatch):
    """A shard of 60,000 symbols with room for 6,000 entries gives the windows that brute force finds, and so does one gram's overflow."""
    r = random.Random(18)
    base = [bytes(r.choices(b"abcd ", k=160)) for _ in range(60)]
    contexts = []
    for k in range(400):
        c = bytearray(r.choice(base))
        for _ in range(r.randint(0, 2)):
            c[r.randrange(160)] = r.choice(b"abcd ")
        contexts.append((bytes(c[r.randint(0, 20) :]), r.randint(0, 200), k, r.randint(0, 9)))
    want = _repeated(contexts, 50)
    monkeypatch.setattr(induced, "MANY", 1000)
    shard = suffix_dedup.Shard(memory=6000)
    for x in contexts:
        shard.add(*x)
    assert shard.size > 10 * 5500 and shard.memory == 6000
    got = {(a, d, i) for x in shard.repeated(50) for a, d, lo, hi in x.tolist() for i in range(lo, hi + 1)}
    assert got == want and len(want) > 1000
    monkeypatch.setattr(suffix_dedup, "HELD", 2000)
    rows = [[0] * len(contexts), [5] * len(contexts), *map(list, zip(*[(k, d, lo, lo + len(c) - 50, c, 0) for c, k, d, lo in contexts]))]
    out = suffix_dedup._sorted_shards(iter([suffix_dedup._batch(rows)]), 50)
    got = {(a, d, i) for b in out for a, d, lo, hi in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5))) for i in range(lo, hi + 1)}
    assert got == want


def test_suffix_dedup_refuses_spans_it_cannot_hold(docs):
    for span in (32, 128, 200):
        with pytest.raises(ValueError):
            suffix_dedup.without_repeats(docs, span=span)


def test_warc_round_trip(spark, tmp_path):
    big = words(40_000)
    rows = [(5, "http://a/é x", "same"), (3, None, "same"), (9, "u", None), (2, "u", ""), (4, "v", big), (None, "w", "same"), (3, None, "same"), (7, "q", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, warc.archived(pages, path=f"file://{tmp_path}/w").collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    first = {"same": 3, "": 2}
    want = []
    for i, _, h in rows:
        f = first.get(h or "")
        late = f is not None and i != f
        want.append((i, len((h or "").encode()), sha(h), "revisit" if late else "response", f if late else None))
    assert got == sorted(want, key=str)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    one = warc.read_archives(spark, f"file://{tmp_path}/w", True).where("record_id = '<urn:page:4>'").collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == big
    assert warc.read_archives(spark, f"file://{tmp_path}/w").where("record_type in ('response')").where("payload is not null").isEmpty()
    assert warc.archived(pages.limit(0), path=f"file://{tmp_path}/none").isEmpty()


def test_warc_appends_and_archives_of_others(spark, tmp_path):
    """Two writes to one folder are both read, an overwrite replaces them, and a folder without manifests is read whole."""
    warc.register(spark)
    path = f"{tmp_path}/w"
    page = lambda i: spark.createDataFrame([(i, "u", f"text {i}", "x", "y")], "page_id string, url string, html string, PAGE string, payload string")
    for i in ("a  b", "null"):
        warc.write_pages(page(i), f"file://{path}")
    read = lambda at: sorted(bytes(r.payload).decode() for r in warc.read_archives(spark, at, True).collect())
    assert read(path) == ["text a  b", "text null"]
    other = tmp_path / "other"
    other.mkdir()
    body = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    import gzip

    (other / "x.warc.gz").write_bytes(gzip.compress(body) + gzip.compress(body.replace(b"hello", b"world")))
    assert read(str(other)) == ["hello", "world"]
    warc.read_archives(spark, str(other), True).write.format("warc").mode("overwrite").option("path", path).save()
    assert read(path) == ["hello", "world"]
    rows = [("a  b", "u", None), (" null", "u", ""), ("null", None, "x" * 30), (None, "u", "x" * 30), ("é\n", "u", "x" * 30)]
    got = warc.archived(spark.createDataFrame(rows, "page_id string, url string, html string"), least=10, path=f"{tmp_path}/ids").collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {("a  b", "response", None), (" null", "response", None), ("null", "response", None), (None, "revisit", "null"), ("é\n", "revisit", "null")}


def test_warc_headers_are_read_without_the_payload(tmp_path):
    import pyarrow as pa

    data = b"".join(warc.member(warc.record({"WARC-Type": "response", "WARC-Record-ID": str(i)}, b"a" * 10_000_000)) for i in range(3))
    f = pa.BufferReader(data)
    member = warc.Member(f, 0)
    assert member.beginning()[0]["WARC-Record-ID"] == "0" and member.out <= warc.HEAD
    assert [h["WARC-Record-ID"] for h, _ in warc.read_records(f, warc.Wanted({"record_id": ["1"]}, False))] == ["1"]
    assert [len(x) for _, x in warc.read_records(f, warc.Wanted({"record_id": ["2"]}, True))] == [10_000_000]


def test_secret_scan(spark, docs, none):
    key = "".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=40))
    texts = ['a Token = "abcdef12" b', "password: abc", "é AKIA" + "A1" * 8 + " AKIAX", "x " + "0af" * 8 + " y", f"auth key={key} end", None, "token=tokentoken", "ſecret=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert got[0].spans == "assign:2:19" and got[1].spans == "" and got[2].spans == "access:2:22" and got[3].spans == "hex:2:26"
    assert got[4].spans.startswith("cnn:") and got[4].n_cnn == 1 and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[6].n_assign == 1 and got[7].n_assign == 0 and got[0].base_sha256 == hashlib.sha256(b"assign:2:19").hexdigest()
    assert secrets.scan(docs).count() == len(corpus()) and secrets.scan(none).isEmpty()


def test_network_on_held_out_findings():
    x, y = secrets.encoded(secrets.labelled(1000, 77))
    net = secrets.trained()
    hit = net.probability(x) >= net.threshold
    assert hit[y == 1].mean() > 0.95 and hit[y == 0].mean() < 0.03


def test_calibration_keeps_recall_below_one_half():
    r = np.random.default_rng(16)
    y = np.repeat([0.0, 1.0], 1000)
    x = (r.standard_normal(2000) + y).reshape(-1, 1)
    net = secrets.Network.new(1)
    net.raw = lambda x: x[:, 0]
    net.calibrate(x, y, 0.97)
    assert (net.probability(x[y == 1]) >= net.threshold).mean() >= 0.97


def test_keys_at_the_end_of_long_paths(spark):
    r = random.Random(15)
    key = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 40)))
    path = "see example.com/api/v1/projects/customer-portal/webhooks/"
    texts = [path + key() + " for it" for _ in range(100)] + [f"{path}{a}/{b}/settings/2024 for it" for a in ("orders", "invoices", "members") for b in ("north-region", "delivery", "archive")]
    n = [x.n_cnn for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sum(n[:100]) >= 95 and sum(n[100:]) == 0


def test_resampling_leaves_out_what_the_target_lacks(spark, none):
    r = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        t = words(80, r) + (" zzqqx badword zzqqx badword" * 3 if bad else "")
        rows.append((i, t))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [(None, ""), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = [x.doc_id for x in resample.resample(df, lab).collect()]
    clean = [i for i in range(600) if i % 6]
    assert not [i for i in kept if i is not None and i < 600 and i % 6 == 0] and len(set(clean) & set(kept)) > 0.95 * len(clean)
    exact = resample.resample(df, lab, k=100).collect()
    assert len(exact) == 100 and resample.resample(none.select("doc_id", "text"), lab).isEmpty()


def test_resampling_weighs_a_single_rare_word(spark):
    """A word that stands once in each bad document, and never in the targets, tells against it."""
    r = random.Random(14)
    rows = [(i, words(60, r) + (" zzqqxwordy" if i % 6 == 0 else "")) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900) if i % 6 < 3], "doc_id long, quality int, toxic int")
    w = {x.doc_id: x.log_weight for x in resample.weighted(df, lab).collect()}
    assert np.mean([w[i] < -1 for i in w if i % 6 == 0]) > 0.9 and np.mean([w[i] > -1 for i in w if i % 6]) > 0.9


def test_kth_largest_key(spark):
    r = random.Random(11)
    keys = [r.choice([r.gauss(0, 1), 0.5]) for _ in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "gumbel_key double")
    for k in (1, 37, 250, 499, 500):
        cut, spare = resample._kth(df, k, bins=8)
        top = sorted(keys, reverse=True)
        assert cut == top[k - 1] and (sum(x > cut for x in keys) + spare == k if spare else sum(x >= cut for x in keys) == k)
