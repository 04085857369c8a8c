"""Stages and operators on tables with awkward columns and rows, and against plain implementations."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, __kd string, __kt int, __live string, __times int, __k string, `a.b` string, whole string, kd int, h int, row string, base string, root string, m map<string,int>"
WORDS = [f"w{i}" for i in range(60)]


def awkward():
    r = random.Random(11)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    out = [None, "", " ", "a", "one two three four", "x" * 3000, text(12_000), f"key {text(3)} token={'Z9' * 12} end", f"Zq9{'aB3x' * 8} hello"]
    base = text(200)
    for i in range(12):
        w = base.split()
        w[r.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    out += [text(r.randrange(1, 300)) for _ in range(30)]
    more = lambda i: ("k", i, "l", 2, "x", "dot", "w", 1, 2, "r", "b", "t", {"a": 1})
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), *more(i)) for i, t in enumerate(out)]
    rows += [rows[10]] * 4 + [(None, base, "en", "s1", 1, *more(0))] * 3 + [(None, None, None, None, None, *more(1))]
    # Equal in id, text and source, but not in another column.
    rows += [(500, base + " again", lang, "s1", 1, *more(0)) for lang in ("en", "fr", "fr")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    spark.createDataFrame(awkward(), CLASH).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def key(r):
    return tuple(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_toxicity_stage(spark, docs):
    from shuttleframe.llm.toxicity import drop_toxic

    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    kept = Counter(key(r) for r in drop_toxic(docs, labels.limit(0)).collect())
    assert kept == Counter(key(r) for r in awkward())
    some = drop_toxic(docs, labels)
    assert some.columns == docs.columns and not Counter(key(r) for r in some.collect()) - Counter(key(r) for r in awkward())


def test_near_duplicates_stage(spark, docs):
    from shuttleframe.llm import simhash

    texts = sorted({r[1] or "" for r in awkward()})
    sets = [set(simhash.shingles(t, 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or common and common / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    group = {t: find(i) for i, t in enumerate(texts)}
    first = {}
    for r in awkward():
        g = group[r[1] or ""]
        first[g] = min(first.get(g, math.inf), -math.inf if r[0] is None else r[0])
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    rows = [key(r) for r in got.collect()]
    assert not Counter(rows) - Counter(key(r) for r in awkward())
    assert sorted((group[r[1] or ""], -math.inf if r[0] is None else r[0]) for r in rows) == sorted(first.items())
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_texts_whose_hashes_clash_are_told_apart(spark, monkeypatch):
    from shuttleframe.llm import simhash

    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(6)]
    docs = spark.createDataFrame(rows + [(9, rows[0][1])], "doc_id long, text string")
    own = F.xxhash64
    # The first hash is the same for all texts; the second one isn't.
    monkeypatch.setattr(simhash.F, "xxhash64", lambda *c: own(*c) if len(c) > 1 else F.lit(7).cast("long"))
    keyed, firsts = simhash.with_text_keys(docs)
    got = {r["kt"]: (r["kd"], r["m"]) for r in firsts.collect()}
    assert len(got) == 6 and sorted(got.values()) == [(0, 2), *[(i, 1) for i in range(1, 6)]]


def test_near_duplicates_recall(spark):
    """Every row whose id is divisible by 5 (and so by 50) against all rows: similarities of 0.8 or more are linked."""
    from shuttleframe.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = {t: np.unique(simhash.shingles(t, 5)) for t in {t for _, t in rows}}
    holders = defaultdict(list)
    for t, s in sets.items():
        for h in s.tolist():
            holders[h].append(t)
    kept = {r["text"] or "" for r in simhash.drop_near_duplicates(docs).select("text").collect()}
    asked = {t for i, t in rows if i % 5 == 0 and len(sets[t])}
    pairs = missed = 0
    for t in asked:
        common = Counter(x for h in sets[t].tolist() for x in holders[h] if x != t)
        for x, k in common.items():
            if k / (len(sets[t]) + len(sets[x]) - k) >= 0.8:
                pairs += 1
                missed += t in kept and x in kept
    assert pairs > 10 and missed == 0


def test_secrets_stage(spark, docs):
    from shuttleframe.llm import secrets

    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    got = Counter((r["doc_id"], r["lang"], r["text"] if r["text"] is None else len(r["text"])) for r in clean.collect())
    assert got == Counter((r[0], r[2], r[1] if r[1] is None else len(r[1])) for r in awkward())
    by = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "Z9" not in by[7] and by[7].startswith("key ") and by[7].endswith(" end") and "*" in by[8]
    untouched = [i for i in range(9, 40)]
    plain = {r[0]: r[1] for r in awkward()}
    assert all(by[i] == plain[i] for i in untouched)
    assert secrets.redact(docs.limit(0)).count() == 0


def test_secrets_in_runs_of_matches(spark, monkeypatch):
    from shuttleframe.llm import secrets

    monkeypatch.setattr(secrets, "RUN", 4)
    text = " ".join(f"token=abcdefgh{i} AKIA{'Q1' * 8} {'0a' * 16}" for i in range(41))
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    got = secrets.find(docs, ["doc_id"]).select(secrets.joined("base").alias("b")).first()["b"]
    want = [(m.start(), 0, m.end()) for m in re.finditer(r"token=[A-Za-z0-9+/_.=-]+", text)]
    want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]{12,}", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)]
    assert got == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(want))


def test_mixing_stage(spark, docs, monkeypatch):
    from shuttleframe.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 3)
    got = Counter(key(r) for r in mixing.mix_documents(docs).collect())
    have = Counter(key(r) for r in awkward())
    assert got == Counter(key(r) for r in mixing.mix_documents(docs).collect())
    taken, size, largest = Counter(), Counter(), Counter()
    for r, n in have.items():
        assert got[r] <= 2 * n and (got[r] == 0 or words(r[1]))
        taken[r[3]] += got[r] * len(words(r[1]))
        size[r[3]] += n * len(words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    assert not set(got) - set(have)
    from .test_operators import water

    for s, goal in water(size).items():
        assert abs(taken[s] - goal) <= largest[s]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_words_that_the_mix_takes(spark, tmp_path, monkeypatch):
    """The query's result against water filling and its limits, with many equal rows."""
    from shuttleframe.llm import mixing

    from .test_operators import water

    monkeypatch.setattr(mixing, "CHUNK", 5)
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.randrange(0, 40)), r.choice(["a", "b", "c", None])) for i in range(150)] + [(7, "same text of five words", "b")] * 60
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op8_mixing(spark, str(tmp_path)).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    size, taken, goal = Counter(), Counter(), {}
    for _, t, s in rows:
        size[s] += len(words(t))
    of = {s: n for s, n in size.items()}
    for x in got:
        s = next(s for s, n in of.items() if n == x["source_size"])
        taken[s] += x["taken"]
        goal[s] = x["target"]
        assert 0 <= x["taken"] <= 2 * x["size"]
    for s, want in water(size).items():
        assert abs(goal[s] - want) < 1e-6 and abs(taken[s] - want) <= 1
    assert len({x["taken"] for x in got if x["size"] == 5}) > 1 or goal["b"] in (5 * size["b"], size["b"], 2 * size["b"])
    again = mixing.op8_mixing(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def slow_rgb(picture):
    """The tensor by the definition of the inverse transform, sample by sample."""
    most = max(c.h for c in picture.components), max(c.v for c in picture.components)
    zig = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    wave = [[(math.sqrt(0.125) if k == 0 else 0.5) * math.cos((2 * n + 1) * k * math.pi / 16) for n in range(8)] for k in range(8)]
    planes = []
    for c in picture.components:
        rows, columns = c.blocks.shape[:2]
        plane = np.zeros((8 * rows, 8 * columns))
        for i in range(rows):
            for j in range(columns):
                for k, (u, v) in enumerate(zig):
                    f = float(c.blocks[i, j, k]) * float(picture.quant[c.table][k])
                    if f:
                        for y in range(8):
                            for x in range(8):
                                plane[8 * i + y, 8 * j + x] += f * wave[u][y] * wave[v][x]
        sy, sx = most[1] // c.v, most[0] // c.h
        planes.append(np.array([[plane[y // sy, x // sx] for x in range(picture.width)] for y in range(picture.height)]))
    y, b, r = planes
    out = np.stack((y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b), 2) + 128
    return np.clip(np.rint(out), 0, 255)


def test_jpeg_tensor_by_definition():
    from shuttleframe.llm import jpeg

    data = np.random.default_rng(4).integers(0, 256, 192 * 4, np.uint8).tobytes()
    picture = jpeg.read(jpeg.encode(data))
    assert np.abs(jpeg.rgb(picture).astype(int) - slow_rgb(picture)).max() <= 1  # a half may be rounded either way
    tensor = jpeg.rgb(picture)
    h, w = tensor.shape[:2]
    means = [tensor[y : y + h // 2, x : x + w // 2, c].astype(float).mean() for y in (0, h // 2) for x in (0, w // 2) for c in range(3)]
    assert jpeg.feature(tensor) == f"{h}x{w}:" + ",".join(f"{m:.2f}" for m in means)


def test_jpeg_of_a_payload_in_several_pictures(monkeypatch):
    from shuttleframe.llm import jpeg

    text = "ä long text, " * 200
    one = jpeg.measures(text, True, True)
    monkeypatch.setattr(jpeg, "PART", 192 * 3)
    many = jpeg.measures(text, True, True)
    sent = jpeg.padded(text)
    assert one[:4] == many[:4] and many[2] == hashlib.sha256(sent).hexdigest() and many[1] == len(sent)
    assert many[6].count(";") == -(-len(sent) // (192 * 3)) - 1 and many[5] == hashlib.sha256(many[8]).hexdigest()


M64 = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_parse(symbols):
    """One level of one sequence, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    sym = [mix((s + mix(n)) & M64) if n > 1 else s for s, n in runs]
    if not sym:
        return []
    before, after = [mix(i) for i in range(1, 9)], [mix(i) for i in range(11, 15)]
    line = before + sym + after
    label = line
    for _ in range(4):
        new = [label[0] & 1]
        for a, b in zip(label[1:], label, strict=False):
            low = ((a ^ b) & -(a ^ b)).bit_length() - 1
            new.append(2 * low + (a >> low & 1))
        label = new
    for c in (5, 4, 3):
        label = [min({0, 1, 2} - {label[i - 1], label[i + 1]}) if 0 < i < len(label) - 1 and v == c else v for i, v in enumerate(label)]
    names, part = [], []
    for i in range(len(sym)):
        k = i + len(before)
        if i and label[k - 1] < label[k] > label[k + 1]:
            names.append(part)
            part = []
        part.append(sym[i])
    names.append(part)
    return [mix(sum(mix((s + j * 0x9E3779B97F4A7C15) & M64) for j, s in enumerate(p)) & M64) for p in names]


def plain_fingerprint(text, levels=4, keep=32):
    symbols, out = [mix((ord(c) + 1) & M64) for c in text], []
    for level in range(levels):
        symbols = plain_parse(symbols)
        out.append("".join(f"{h:08x}" for h in sorted({mix((s + level + 1) & M64) >> 32 for s in symbols})[:keep]))
    return ".".join(out)


def test_parsing_equals_a_plain_implementation():
    from shuttleframe.llm import parsing

    r = random.Random(2)
    some = ["", "a", "aa", "ab", "aaaaabbbbb" * 30, "äöü😀" * 50, *["".join(r.choice("abcd e") for _ in range(r.randrange(1, 900))) for _ in range(25)]]
    assert [parsing.text_of(s) for s in parsing.sketches(some)] == [plain_fingerprint(t) for t in some]
