"""Operators against brute force on a small table with every awkward row, and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kd string, size string, row string, fp string"


def fixture_rows():
    r = random.Random(7)
    words = ["the", "of", "and", "Tion", "ándere", "zu", "idiot", "moron", "x1", "%%%", "über", "ling"] + [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage, line = text(300), text(60), "licensed under the common line of all. "
    out = [None, "", " ", "\n\t", "a", "one two", "one two three", "Ünïcode ẞtraße 😀 word " * 9, line * 40, "a" * 700, "ab" * 500]
    for _ in range(6):
        out.append(base)
    for i in range(40):
        w = base.split()
        w[r.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    for i in range(25):
        out.append(text(r.randrange(5, 200)) + "\n" + passage + " " + text(r.randrange(0, 90)))
    for i in range(20):
        out.append(text(r.randrange(1, 400)))
    out.append(text(9000))
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    out += [f'x token = "{key}" y', f'password: "short" api_key="{"Q" * 9}" AKIA{"A1" * 8} {key}z', f"TOKEN=token:abcdefghijk \x01 secret=a\x02b {key}", "token=api_key:abcdefgh"]
    out += [f"Zq9{'aB3x' * 8} hello", f"Zq9{'aB3x' * 8} again"]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 5}", len(t or ""), "k", "s", "r", "f") for i, t in enumerate(out)]
    rows.append(rows[20])  # a row repeated as a whole
    rows.append((None, passage, "en", "s1", 1, "k", "s", "r", "f"))
    return rows


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def test_jpeg_round_trip(docs, rows, empty):
    from shuttleframe.llm import jpeg

    got = by_id(jpeg.media(docs, ["doc_id"], files=True, tensors=True))
    for i, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i][0]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(want[-16:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert len(r["tensor"]) == 3 * r["height"] * r["width"]
    assert sum(map(len, got.values())) == len(rows)
    assert jpeg.media(empty, ["doc_id"]).count() == 0


def test_jpeg_arrays_and_bit_reader_agree(monkeypatch):
    from shuttleframe.llm import jpeg

    data = np.random.default_rng(1).integers(0, 256, 192 * 9, np.uint8).tobytes()
    file = jpeg.encode(data)
    fast = jpeg.read(file)
    monkeypatch.setattr(jpeg.Scan, "whole", lambda self: False)
    slow = jpeg.read(file)
    assert all((a.blocks == b.blocks).all() for a, b in zip(fast.components, slow.components, strict=True))
    assert jpeg.payload_of(slow) == data


def test_jpeg_reads_runs_restarts_and_new_coefficients():
    """A grey picture of three blocks: end-of-band runs, zero runs, refinement with new coefficients, restarts."""
    from shuttleframe.llm import jpeg

    seg, bits = jpeg._segment, lambda s: jpeg._stuffed(np.frombuffer(s.encode(), np.uint8) - 48)
    tables = jpeg._table(0, 0, list(range(12)), 4) + jpeg._table(1, 0, [0x00, 0x01, 0x10, 0x21, 0xF0, 0x02], 3)
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [1] * 64)) + seg(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])) + tables
    dc = jpeg._scan([(1, 0, 0)], 0, 0, 0, 0, bits("0011" + "101") + b"\xff\xd0" + bits("0001" + "0") + b"\xff\xd1" + bits("0000"))
    # Block 0: 1 at place 1 and -1 three places on (run 2), end of band for blocks 0 and 1 (run symbol 0x10, bit 0).
    first = jpeg._scan([(1, 0, 0)], 1, 63, 0, 1, bits("001" + "1" + "011" + "0" + "010" + "0" + "100" + "001" + "1" + "000"))
    # Refinement: block 0 gets a new 1 at place 2 past a corrected place 1; then its end, with one correction; others end.
    fine = jpeg._scan([(1, 0, 0)], 1, 63, 1, 0, bits("001" + "1" + "1" + "000" + "1" + "000" + "000" + "0"))
    file = head + seg(0xDD, b"\0\1") + dc + seg(0xDD, b"\0\0") + first + fine + b"\xff\xd9"
    b = jpeg.read(file).components[0].blocks[0]
    assert b[:, 0].tolist() == [5, -1, 0]
    assert b[0, 1:6].tolist() == [3, 1, 0, -3, 0] and not b[0, 6:].any() and not b[1, 1:].any()
    assert b[2, 17] == 2 and np.count_nonzero(b[2, 1:]) == 1
    assert jpeg.decode(file).shape == (8, 24, 3)


def test_inverse_dct_is_orthonormal():
    from shuttleframe.llm import jpeg

    assert np.allclose(jpeg.IDCT @ jpeg.IDCT.T, np.eye(64), atol=1e-5)
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_parsing(docs, rows, empty):
    from shuttleframe.llm import parsing

    got = parsing.fingerprints(parsing.with_next(docs)).collect()
    assert len(got) == len(rows)
    order = sorted(((t or "", i) for i, t, *_ in rows), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    want = Counter()
    prints = {}
    for k, (t, i) in enumerate(order):
        after = order[(k + 1) % len(order)][0]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest()] += 1
        prints[i] = (t, e, after)
    assert want == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
    for r in got:
        t, e, after = prints[r["doc_id"]]
        a, b, c = (parsing.sketches([x])[0] for x in (t, e, after))
        assert r["fingerprint"] == parsing.text_of(a) and r["edited_fingerprint"] == parsing.text_of(b)
        assert r["near_edited"] == parsing.likeness(a, b) and r["near_next"] == parsing.likeness(a, c)
    assert parsing.fingerprints(parsing.with_next(empty)).count() == 0


def test_parsing_is_locally_consistent():
    from shuttleframe.llm import parsing

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh ") for _ in range(4000))
    core = word()

    def phrases(text):
        lengths, sym = np.array([len(text)]), parsing.mix64(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        lengths, names = parsing.parse(lengths, sym)
        return names.tolist()

    a, b = phrases(word()[:1237] + core), phrases(word()[:3001] + core)
    same = 0
    while same < min(len(a), len(b)) and a[-1 - same] == b[-1 - same]:
        same += 1
    assert same > len(phrases(core)) - 12


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    from shuttleframe.llm import packing

    got = packing.pack_documents(docs, packing.tokenizer_path()).collect()
    full = Tokenizer.from_file(packing.tokenizer_path())
    want, lengths = Counter(), 0
    for i, t, *_ in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
            lengths += len(part)
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.1 * lengths / 4096 + 1
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0


def test_fullest_is_the_best_subset():
    from shuttleframe.llm.packing import fullest

    r = random.Random(2)
    for _ in range(200):
        room = r.randrange(1, 60)
        counts = [0] * 61
        for _ in range(r.randrange(0, 9)):
            counts[r.randrange(1, 40)] += 1
        lengths = [x for x in range(60, 0, -1) if counts[x]]
        sums = {0}
        for x in lengths:
            for _ in range(counts[x]):
                sums |= {s + x for s in sums if s + x <= room}
        chosen = fullest(counts, lengths, room)
        assert sum(chosen) == max(sums) and all(n <= counts[x] for x, n in Counter(chosen).items())


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    from shuttleframe.llm.packing import tokenizer_path
    from shuttleframe.llm.tokens import word_bpe

    full, own = Tokenizer.from_file(tokenizer_path()), word_bpe(tokenizer_path(), 50)
    for t in ["It's WE'RE I'LL x'S", "İstanbul ΣΑΣ aİ! ß ẞ ſ 'ſ", "été Å", "a<|endoftext|>b <|startoftext|>", " x y\x85z\x1cq", "  12 3.4%%% ,,", "日本語 テスト😀😀", "Ǆ ŉ ﬁ", "\n\n\t"]:
        assert np.frombuffer(own(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, t


def brute_bytes(rows):
    texts = [(i, t or "") for i, t, *_ in rows]
    seen = Counter()
    for _, t in texts:
        raw = t.encode()
        seen.update(raw[s : s + 200] for s in range(len(raw) - 199))
    out = {}
    for i, t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 199):
            if seen[raw[s : s + 200]] > 1:
                gone[s : s + 200] = True
        spans = int(((gone[:-1]) & ~np.concatenate(([False], gone[:-2]))).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[i, t] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [2000, 3])
def test_suffix_dedup(docs, rows, empty, monkeypatch, crowd):
    from shuttleframe.llm import suffixes, windows

    monkeypatch.setattr(windows, "CROWD", crowd)
    got = suffixes.doc_ids(suffixes.without_repeats(docs).drop("kt", "spans")).collect()
    want = brute_bytes(rows)
    expect = Counter((i, *want[i, t or ""]) for i, t, *_ in rows)
    assert expect == Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert suffixes.without_repeats(empty).count() == 0


def test_suffix_order_is_the_suffix_array():
    from shuttleframe.llm import suffixes

    r = np.random.default_rng(5)
    for size in (40, 700, 3000):
        text = np.zeros(size + 20 * suffixes.V, np.uint8)
        text[:size] = r.integers(1, 3, size)
        text[size // 2 : size // 2 + size // 4] = text[: size // 4]
        at = np.arange(0, size - 5)
        # Suffixes of a bucket share the residue of their positions.
        order = suffixes.suffix_order(text, at, at % suffixes.V)
        raw = text.tobytes()
        assert [at[o] for o in order] == sorted(at, key=lambda p: (p % suffixes.V, raw[p : p + 8 * suffixes.V], p))
    v = suffixes.V
    assert {(a - b) % v for a in suffixes.COVER for b in suffixes.COVER} == set(range(v))


@pytest.mark.parametrize("crowd", [2000, 3])
def test_substrings(docs, rows, empty, monkeypatch, crowd):
    from shuttleframe.llm import substrings, windows

    monkeypatch.setattr(windows, "CROWD", crowd)
    texts = sorted({(-(1 << 63) if i is None else i, t or "") for i, t, *_ in rows})
    seen, want = set(), {}
    for i, t in texts:
        w = t.encode().split()
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = True
            seen.add(k)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want[i, t] = (len(w), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest())
    expect = Counter((i, *want[-(1 << 63) if i is None else i, t or ""]) for i, t, *_ in rows)
    got = substrings.doc_ids(substrings.without_repeats(docs).drop("kt", "spans")).collect()
    assert expect == Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got)
    assert substrings.without_repeats(empty).count() == 0


def brute_fingerprint(t, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("cell", [32, 1])
def test_simhash(spark, docs, rows, empty, monkeypatch, cell):
    from shuttleframe.llm import simhash
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "CELL", cell)
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    root = closure(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, *_), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    got = simhash.near_duplicates(docs, ["doc_id"])
    first = got.groupBy("root").agg(F.min("doc_id").alias("c"))
    have = Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["c"]) for r in got.join(first, "root").collect())
    assert have == Counter((i, f, least.get(root[f])) for (i, *_), f in zip(rows, fps, strict=True))
    assert simhash.near_duplicates(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("cell", [32, 2])
def test_simhash_links_lose_none(spark, monkeypatch, cell):
    from shuttleframe.llm import simhash
    from shuttleframe.llm.components import components

    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(9)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for _ in range(r.randrange(1, 4)):
                x ^= 1 << r.randrange(64)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    m = (1 << 64) - 1
    want = closure(fps, lambda a, b: ((a ^ b) & m).bit_count() <= 2)
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")))
    got = {x["node"]: x["root"] for x in found.collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_of_similarity_keep_one(spark):
    from shuttleframe.llm import simhash

    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(25):
        base = [r.choice(words) for _ in range(r.choice((60, 300, 900)))]
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(len(w) // 100):  # one word in a hundred: a similarity of 0.9, about
                w[r.randrange(len(w))] = r.choice(words)
            groups.setdefault(g, []).append(len(rows))
            rows.append((len(rows), " ".join(w), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted(min(ids) for ids in groups.values())


def test_near_duplicates_in_a_family_with_a_template(spark):
    from shuttleframe.llm import simhash

    r = random.Random(8)
    token = lambda: f"w{r.randrange(10**9)}"
    template = [token() for _ in range(256)]
    rows = []
    for _ in range(1000):  # two of a pair are 0.9 alike, other members 0.74
        own = [token() for _ in range(32)]
        rows += [" ".join(template + own + [token() for _ in range(12)]) for _ in range(2)]
    for _ in range(20):  # chains whose neighbours are alike, the ends not
        chain = template + [token() for _ in range(60)]
        for _ in range(6):
            rows.append(" ".join(chain))
            chain = chain[:256] + chain[272:] + [token() for _ in range(16)]
    r.shuffle(rows)
    sets = [set(simhash.shingles(t, 5).tolist()) for t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for h in s:
            holders[h].append(i)
    holders = {h: np.array(at) for h, at in holders.items()}
    counts, root = np.zeros(len(rows), np.int64), list(range(len(rows)))
    sizes, fps = np.array([len(s) for s in sets]), np.array([simhash.fingerprint(t, 5) for t in rows], np.uint64)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        counts[:] = 0
        for h in s:
            counts[holders[h]] += 1
        alike = counts / (sizes[i] + sizes - counts) >= 0.8
        for j in np.flatnonzero(alike | (np.bitwise_count(fps ^ fps[i]) <= 2)):
            x, y = sorted((top(i), top(int(j))))
            root[y] = x
    want = [i for i in range(len(rows)) if top(i) == i]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, source string").repartition(4)
    assert sorted(x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()) == want


def test_components_of_a_chain(spark):
    from shuttleframe.llm.components import components

    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_toxicity_learns_and_holds_out(spark, tmp_path):
    from shuttleframe.llm import toxicity

    d = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    hit = sum(r["predicted"] for r in held if r["toxic"]) / sum(r["toxic"] for r in held)
    false = sum(r["predicted"] for r in held if not r["toxic"]) / sum(1 - r["toxic"] for r in held)
    assert hit > 0.85 and false < 0.03


def test_toxicity_trains_on_every_window():
    from shuttleframe.llm import toxicity

    marked = [(8 * i, [0]) for i in range(12)] + [(8 * i, [1]) for i in range(12, 40)]
    model = toxicity._train([(320, marked, [0] * 12 + [1] * 28)], ["w=early", "w=late"])
    assert model.weights["w=late"] > 1 > model.weights["w=early"]


def test_toxicity_skips_a_row_that_does_not_fit(spark, monkeypatch):
    from shuttleframe.llm import toxicity

    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    rows = [(i, f"{'idiot ' * 3 if i % 2 else ''}plain words number{i} of all", i % 2) for i in range(400)]
    rows += [(1000 + i, "filler " * (3_500 - i), 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    taken = []
    monkeypatch.setattr(toxicity, "fit", taken.extend)
    toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    kept = [t for i, t, _ in rows if i < 1000 and zlib.crc32(str(i).encode()) % 5]
    assert sorted(t for t, _ in taken) == sorted(kept)


def test_toxicity_offsets_where_lower_casing_changes_the_length(spark):
    from shuttleframe.llm import toxicity

    model = toxicity.Model({"w=idiot": 12.0}, curve=(1.0, 1.0, -1.0))
    text = "\u0130stanbul you IDIOT and Idiot \u0130"
    docs = spark.createDataFrame([(1, text), (2, text.replace("\u0130", "I"))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(m.start(), m.end()) for m in re.finditer("idiot", text, re.I)]
    assert got[1]["spans"] == got[2]["spans"]


def test_crf_marginals_equal_enumeration():
    from itertools import product

    from shuttleframe.llm.toxicity import Model, marginals

    m = Model(transitions=np.array([[0.3, -0.7], [-0.2, 1.1]]), bias=-1.3)
    n, at, pot = 7, np.array([1, 2, 5]), np.array([2.0, -0.5, 1.5])
    u = np.full(n, m.bias)
    u[at] = pot
    z, p = 0.0, np.zeros(n)
    for y in product((0, 1), repeat=n):
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(m.transitions[a, b] for a, b in zip(y, y[1:])))
        z += w
        p += w * np.array(y)
    got, log_z = marginals(m, n, at, pot)
    assert np.allclose(got, (p / z)[at]) and np.isclose(log_z, np.log(z))
    assert np.isclose(marginals(m, 4, np.zeros(0, int), np.zeros(0))[1], np.log(sum(
        np.exp(sum(m.bias * a for a in y) + sum(m.transitions[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4))))


def _by_enumeration(chains, w, trans, bias):
    """The tags' log-likelihood, by all taggings of every chain."""
    from itertools import product

    total = 0.0
    for n, marked, tags in chains:
        u = np.full(n, bias)
        for i, ids in marked:
            u[i] += w[ids].sum()
        own = np.zeros(n, int)
        own[[i for i, _ in marked]] = tags
        weigh = lambda y: sum(u[i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:]))
        total += weigh(own) - np.log(sum(np.exp(weigh(y)) for y in product((0, 1), repeat=n)))
    return total


def _by_differences(likelihood, w, trans, bias, step=1e-5):
    flat = np.concatenate([w, trans.ravel(), [bias]])
    cut = lambda v: (v[: len(w)], v[len(w) : -1].reshape(2, 2), v[-1])
    unit = np.eye(len(flat)) * step
    return np.array([(likelihood(*cut(flat + e)) - likelihood(*cut(flat - e))) / (2 * step) for e in unit])


def test_crf_gradient_equals_enumeration():
    from shuttleframe.llm import toxicity

    rng = np.random.default_rng(5)
    # Neighbours across any border of eight, both ends marked and not, one token, no marked token at all.
    chains = [(9, [(7, [0, 2]), (8, [1])], [1, 1]), (7, [(1, [0]), (2, [2]), (5, [1, 2])], [1, 0, 1]), (1, [(0, [1])], [1]), (1, [], []), (6, [], []), (3, [(0, [0]), (1, [0]), (2, [0])], [0, 1, 0])]
    for _ in range(3):
        w, trans, bias = rng.normal(size=3), rng.normal(size=(2, 2)), float(rng.normal())
        got = toxicity.gradient(toxicity.joined(chains), w, trans, bias)
        want = _by_differences(lambda *v: _by_enumeration(chains, *v), w, trans, bias)
        assert np.allclose(np.concatenate([got[0], got[1].ravel(), [got[2]]]), want, atol=1e-6)


def test_crf_gradient_of_long_chains():
    """Chains far over a block of ``_through``, with short and long runs of plain tokens, against the log partition of ``marginals``."""
    from shuttleframe.llm import toxicity

    rng = np.random.default_rng(6)
    chains = []
    for n in (40_000, 9_000, 3):
        places = np.sort(rng.choice(n, n // 3, replace=False))
        places = places[(places < n // 4) | (places > n // 2)]
        chains.append((n, [(int(i), [int(i) % 4, 4]) for i in places], rng.integers(0, 2, len(places)).tolist()))

    def likelihood(w, trans, bias):
        total = 0.0
        model = toxicity.Model(transitions=trans, bias=bias)
        for n, marked, tags in chains:
            at = np.array([i for i, _ in marked], np.int64)
            u = np.array([bias + w[ids].sum() for _, ids in marked])
            own = np.zeros(n, int)
            own[at] = tags
            total += (u * np.array(tags)).sum() + trans[own[:-1], own[1:]].sum() - toxicity.marginals(model, n, at, u)[1]
        return total

    w, trans, bias = rng.normal(size=5), rng.normal(size=(2, 2)), -0.7
    got = toxicity.gradient(toxicity.joined(chains), w, trans, bias)
    want = _by_differences(likelihood, w, trans, bias, 1e-4)
    assert np.allclose(np.concatenate([got[0], got[1].ravel(), [got[2]]]), want, rtol=1e-5, atol=1e-2)


def test_crf_fit_does_not_depend_on_places():
    """Two toxic neighbours teach the same wherever they stand, but for what nearer ends change in the steps of the fit."""
    from shuttleframe.llm import toxicity

    fits = [toxicity._train([(40, [(k, [0]), (k + 1, [0])], [1, 1])] * 30 + [(40, [], [])] * 30, ["w=x"]) for k in (6, 7, 8, 20)]
    for m in fits:
        assert np.allclose(m.transitions, fits[0].transitions, atol=0.05) and m.transitions[1, 1] > m.transitions[0, 1]


def test_toxicity_score_equals_enumeration(spark):
    from itertools import product

    from shuttleframe.llm import toxicity

    m = toxicity.Model({"w=idiot": 3.0, "p4=stup": 1.5, "s4=rons": 2.0}, np.array([[0.2, -0.4], [-0.1, 0.9]]), -1.5, (1.2, 0.3, -1.0))
    said = ["you idiot", "a stupid idiot, and all the morons there", "stupid", "plain words of no weight", "", None, "Idiot IDIOT idiot"]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), m, ["doc_id"]).collect()}
    for i, text in enumerate(said):
        tokens = re.findall(r"[a-z]+", (text or "").lower())
        found = [[m.weights[f] for f in toxicity.features(t) if f in m.weights] for t in tokens]
        n, z, p = len(tokens), 0.0, np.zeros(len(tokens))
        for y in product((0, 1), repeat=n):
            weight = np.exp(sum((m.bias + sum(found[k])) * y[k] for k in range(n)) + sum(m.transitions[a, b] for a, b in zip(y, y[1:])))
            z += weight
            p += weight * np.array(y)
        expected = sum(p[k] / z for k in range(n) if found[k])
        a, b = np.log1p(expected), np.log1p(1000 * expected / (n + 20))
        assert np.isclose(got[i], 1 / (1 + np.exp(-(1.2 * a + 0.3 * b - 1.0))))


def test_toxicity_awkward_rows(spark, docs, rows, empty):
    from shuttleframe.llm import toxicity

    labels = spark.createDataFrame([(i, 1, int("moron" in (t or ""))) for i, t, *_ in rows if i is not None], "doc_id bigint, quality int, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert toxicity.drop_toxic(empty, none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No title</title><style>p{x}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Home page of the site</a></header><nav><ul><li><a href="/a">One</a></li><li>Two</li></ul></nav><div class="cookie-notice">We use
cookies here</div><article><h1>The &amp; title</h1><p>First   para<br>goes&nbsp;on <b>and on</b> with many words to read here.</p>
<aside>Buy this now</aside><!-- hidden <p>no</p> --><form>Mail <input name=x></form><p>Second para has more words, too, and ends 1 &lt; 2.</article>
<div id="comments"><p>A reader says many many words here that are not content at all.</p></div><footer>&copy; us <p>Imprint</footer></body>"""


def test_html(spark, empty):
    from shuttleframe.llm import html

    want = "The & title\n\nFirst para goes on and on with many words to read here.\n\nSecond para has more words, too, and ends 1 < 2."
    for w in (html.Weights(), html.fit([PAGE] * 3)):
        assert html.extract(PAGE, w) == want
    assert html.extract("", html.Weights()) == "" and html.extract("<p>", html.Weights()) == ""
    assert html.extract("<p>a" + "<b" * 50_000, html.Weights()) is not None
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x"), (None, "u", "", "x")], "page_id long, url string, html string, text string")
    got = html.main_text(pages, ["page_id", "url"], html.train(pages)).collect()
    assert sorted(r["text"] for r in got) == ["", "", "", want]
    assert html.main_text(pages.limit(0), ["page_id", "url"], html.Weights()).count() == 0


def test_html_finds_the_articles_of_the_pages(spark):
    from shuttleframe.llm import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.op7_html(spark, "/root/testdata/sf0.01").collect()}
    import html as std

    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(std.unescape(re.sub(r"<[^>]*>", " " if 0 else "", re.sub("<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h1|li|ul|tr|td)\b[^>]*>", inner)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


MENU = "<ul>" + '<li><a href="/x">Menu item</a></li>' * 6 + "</ul>"
MARKED = "<html><body><nav>" + MENU + "</nav><article>%s</article><div><a href=x>More stuff to read</a></div><footer>Imprint</footer></body></html>"
PLAIN = "<html><body>" + MENU + "<div>%s</div>" + MENU + "</body></html>"
LONG = "This paragraph has many more words than the rest of this page taken together, and it goes on and on."
ARTICLES = [
    (f"<h1>Title of it</h1><p>Short intro.</p><ul><li>one</li><li>two</li><li>three</li></ul><p>{LONG}</p>", ["Title of it", "Short intro.", "one", "two", "three", LONG]),
    (f"<p>Read <a>the report</a> and <a>its annex</a> now.</p><p>{LONG}</p>", ["Read the report and its annex now.", LONG]),
    (
        f'<p class="share-price">Price up</p><section id="related-work"><p>Earlier work did that.</p></section><p>{LONG}</p>',
        ["Price up", "Earlier work did that.", LONG],
    ),
    (f'<p class="ad">Buy it<p>{LONG}</p><section class="ad-banner">Buy more<p>Last words of it.</p>', [LONG, "Last words of it."]),
    (f"<p>{LONG}</p><table><tr><th>a<th>b<tr><td>c<td>d</table><p>The end.", [LONG, "a", "b", "c", "d", "The end."]),
    (f"<p>{LONG} <svg width=3/>more<p>And <iframe src=x>so <noscript>no</noscript>on.", [f"{LONG} more", "And so on."]),
    (f'<blockquote><p>Quoted <b>words</b> first.</p></blockquote><p>{LONG}</p><div class="post-comments"><p>A reader says so.</p></div>', ["Quoted words first.", LONG]),
    (f'<p>{LONG}</p><article class="comment"><p>A reader says so.</p></article>', [LONG]),
    ("", []),
]


@pytest.mark.parametrize("page", [MARKED, PLAIN])
@pytest.mark.parametrize("body,want", ARTICLES)
def test_html_keeps_the_whole_article(page, body, want):
    from shuttleframe.llm import html

    for w in (html.fit([PAGE] * 3), html.fit([MARKED % ARTICLES[0][0], PAGE, MARKED % f"<p>{LONG}</p>"])):
        got = html.extract(page % body, w)
        if want or page is MARKED:
            assert got == "\n\n".join(want) or not want and "Menu" not in got


def test_html_region_is_the_best_one():
    from shuttleframe.llm import html

    r = random.Random(6)
    for _ in range(300):
        words = [r.choice((0, 0, 1, 2, 5)) for _ in range(r.randrange(0, 14))]
        scores = [float(w) if w else r.choice((-0.5, -1.0, -4.0)) for w in words]
        low, high = html.region(scores, words)
        sums = [sum(scores[a : b + 1]) for a in range(len(words)) for b in range(a, len(words)) if words[a] and words[b]]
        assert sum(scores[low : high + 1]) == max(sums, default=0.0)
        assert (low, high) == (0, -1) if not sums else words[low] and words[high]


def test_html_of_much_broken_markup_ends():
    from shuttleframe.llm import html

    for page in ("<svg>" * 20_000, "<p><b>" * 20_000 + "x", '<div class="ad">' * 20_000 + "x", "<!--" * 20_000, "</p></b>" * 20_000, "<script>" * 20_000):
        assert html.extract(page, html.Weights()) in ("", "x")


def water(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, want = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        left = want - sum(full.values())
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in open_}
        full |= {s: most * sizes[s] for s in over}


def test_mixing(docs, rows, empty):
    from shuttleframe.llm import mixing

    sized = docs.select("doc_id", "source", mixing.words().alias("size"))
    got = mixing.mix(sized).collect()
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, k) for (i, *_), k in zip(rows, n, strict=True))
    sizes = Counter()
    for (_, _, _, s, *_), k in zip(rows, n, strict=True):
        sizes[s] += k
    goal, taken = water(sizes), Counter()
    for r in got:
        assert abs(r["target"] - goal[r["source"]]) < 1e-6 * max(1, goal[r["source"]])
        words = (r["copies"] + r["part"]) * r["size"]
        assert words <= 2 * r["size"] + 1e-6
        taken[r["source"]] += words
    for s, t in goal.items():
        assert abs(taken[s] - t) < 1
    assert mixing.mix(sized).exceptAll(mixing.mix(sized)).count() == 0
    assert mixing.mix(sized.limit(0)).count() == 0


def test_mixing_over_many_chunks(docs, monkeypatch):
    from shuttleframe.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 3)
    monkeypatch.setattr(mixing, "FANOUT", 2)
    got = mixing.mix(docs.select("doc_id", "source", mixing.words().alias("size"))).collect()
    taken, goal, open_ = Counter(), {}, Counter()
    for r in got:
        taken[r["source"]] += (r["copies"] + r["part"]) * r["size"]
        goal[r["source"]] = r["target"]
        open_[r["source"]] += 0 < r["part"] < 1
    assert all(abs(taken[s] - t) < 1 for s, t in goal.items()) and max(open_.values()) <= 1


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(docs, rows, empty):
    from shuttleframe.llm import secrets
    from pyspark.sql import functions as F

    got = by_id(secrets.find(docs, ["doc_id"]).select("*", secrets.joined("base").alias("b"), secrets.joined("spans").alias("s")))
    for i, t, *_ in rows:
        base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t or "") if len(m[2]) >= 8]
        base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 32]
        want = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))
        r = got[i][0]
        assert r["b"] == want and set(want.split(",")) - {""} <= set(r["s"].split(","))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in base) for j in range(3)]
    assert sum(map(len, got.values())) == len(rows)
    assert secrets.find(empty, ["doc_id"]).count() == 0
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    plain = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(len(plain[i] or "") == len(t or "") for i, t, *_ in rows)
    one = next(i for i, t, *_ in rows if t and t.startswith("token=api_key") is False and "AKIA" in t)
    assert "AKIA" not in plain[one]
    assert clean.where(F.col("text").isNull()).count() == 1


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("moron" in (t or ""))) for i, t, *_ in rows if i], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    step = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        after = f(spark, step, str(tmp_path))
        if k < 4:
            assert after.columns == docs.columns
        after.write.parquet(str(tmp_path / f"stage{k}"))
        step = spark.read.parquet(str(tmp_path / f"stage{k}"))
    want = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in step.collect())
    assert want == Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    kept = spark.read.parquet(str(tmp_path / "stage1")).collect()
    assert len({r["text"] for r in kept}) == len(kept)
    assert [r["doc_id"] for r in kept if r["text"] == rows[11][1]] in ([11], [])


ARTICLE = "".join(f"<p>Sentence number {i} of the article has some ten words in it, no less.</p>" for i in range(12))


@pytest.mark.parametrize("page", [
    "<body><div class='post share'>{}</div></body>",
    "<div class='story promo'>{}</div><div class='sidebar'>{side}</div><div class='cookie-notice'>{side}</div>",
    "<div id=page class='page no-sidebar'>{}<div class=sidebar>{side}</div></div>",
    "<body><form id=f action='/x'><div class=content>{}</div><nav>{side}</nav></form></body>",
    "<body><div class='box menu'>{side}</div>{}<ol class=commentlist><li><p>{comment}</p></li></ol></body>",
    "<body>{}<div class='post comments'><p>{comment}</p></div></body>",
    "<p class='ad'>Buy it" + "<b>" * 12 + "<div>{}</div>",
    "<form class=search>{side}</form><div>{}</div><form action=x><label>{side}</label></form>",
])
def test_html_parts_are_judged_by_what_they_hold(page):
    from shuttleframe.llm import html

    side, comment = "Subscribe to our letter today. " * 4, "I don't think so, said the reader. " * 60
    got = html.extract(page.replace("{side}", side).replace("{comment}", comment).replace("{}", ARTICLE), html.Weights())
    assert got.count("Sentence number") == 12 and "Subscribe" not in got and "reader" not in got


def test_html_tags_with_odd_quotes():
    from shuttleframe.llm import html

    def tags(page):
        return [x[:2] for x in html.nodes(page)]

    assert tags('<a title="a < b" href="x">link</a>') == [("open", "a"), ("text", "link"), ("close", "a")]
    assert tags("<p title=it's>one</p><p title='a > b'>two") == [("open", "p"), ("text", "one"), ("close", "p"), ("open", "p"), ("text", "two")]
    assert tags('<a href="x>text</a> and <i>"more"</i>')[:3] == [("open", "a"), ("text", "text"), ("close", "a")]
    assert tags("a < b, c <3 d") == [("text", "a < b, c <3 d")]
    hard = '<a x="<a" ' + 'x="<a" ' * 20_000
    assert html.nodes(hard) and "".join(x[1] for x in html.nodes(hard) if x[0] == "text")
